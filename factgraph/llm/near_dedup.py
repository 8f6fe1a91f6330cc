"""Near-duplicate detection by DartMinHash signatures of weighted word shingles.

A document is a weighted set: its shingles of five lower-cased words, each weighing as often as it occurs. Each
shingle owns a region of the plane, as wide as its weight. Darts fall on the plane as a Poisson process that is a
function of the shingle alone; a dart's height is its rank, and a hash sends it to one of the signature's
coordinates. Of the darts inside a document's regions each coordinate keeps the lowest. Regions are cut into cells
of weight one and into bands of height, so that only bands up to about (k log k + 2k) / weight are looked at: about
k log k darts a document, however long it is. Two documents agree in a coordinate with the probability of their
weighted Jaccard similarity.

Signatures are cut into bands of rows; documents that share a band meet, copies apart, at one of them (a pivot), and
each such pair is verified by its exact similarity. Verified pairs link documents; classes are connected components.
Two rounds of pivots link most of what is similar at a cost in proportion to the buckets. Pairs of a bucket that are
neither compared nor in one class by then are all compared, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkit
from .components import connected
from .textkit import mix, name_pair

SHINGLE = 5
#: 26 bands of 5 coordinates miss a pair of similarity 0.8 with probability 3e-5.
BANDS, ROWS = 26, 5
#: Shingles handled at a time in a task; a longer text is handled alone.
CHUNK = 1 << 17
#: Members of a pivot that are compared in one group.
GROUP = 500
#: Texts and bytes of text that are held at a time where all pairs of a bucket are compared, and texts that pass by them in one group.
BLOCK, BLOCK_BYTES, PASSING = 256, 4 << 20, 4096
#: Darts of ranks below 2**FLOOR are one band.
FLOOR = -8


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle of every text; a text of one to four words has one, of all its words."""
    names, _, _, starts, _, _ = textkit.words(texts)
    count = np.diff(starts)
    n = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    text = np.repeat(np.arange(len(texts)), n)
    begin = np.repeat(starts[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    end = np.minimum(begin + SHINGLE, starts[1:][text])
    out = np.zeros(len(begin), dtype=np.uint64)
    for k in range(SHINGLE):
        has = begin + k < end
        out = np.where(has, name_pair(out, names[np.minimum(begin + k, max(len(names) - 1, 0))], k), out) if len(names) else out
    return out, text


def cells(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of weight one: the i-th occurrence of a shingle in a text is its i-th cell."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (t[1:] == t[:-1])))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(h)))) if len(h) else np.zeros(0, int)
    nth = (np.arange(len(h)) - first).astype(np.uint64)
    return np.where(nth > 0, name_pair(h, nth, 77), h), t


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... events, as 64-bit fractions."""
    n = int(mean + 12 * math.sqrt(mean) + 12)
    log = -mean + np.arange(n) * math.log(mean) - np.cumsum(np.log(np.maximum(np.arange(n), 1)))
    return np.minimum(np.cumsum(np.exp(log)), 1.0)


_TABLES: dict[int, np.ndarray] = {}


def _darts(cell: np.ndarray, text: np.ndarray, band: int, k: int):
    """(text, coordinate, rank, dart) of every dart of a band of height in the cells."""
    low, high = (0.0, 2.0**FLOOR) if band == FLOOR - 1 else (2.0**band, 2.0 ** (band + 1))
    if band not in _TABLES:
        _TABLES[band] = _poisson_table(high - low)
    seed = name_pair(cell, np.full(len(cell), band + 64, dtype=np.uint64), 5)
    chance = (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53
    some = np.flatnonzero(chance >= _TABLES[band][0])
    count = np.searchsorted(_TABLES[band], chance[some], side="right")
    of = np.repeat(some, count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    dart = name_pair(seed[of], nth.astype(np.uint64), 9)
    rank = low + (high - low) * ((dart >> np.uint64(11)).astype(np.float64) * 2.0**-53)
    return text[of], (mix(dart ^ np.uint64(0xABCDEF)) % np.uint64(k)).astype(np.int64), rank, dart


def signatures(hashes: np.ndarray, text: np.ndarray, n: int, k: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, has): n rows of k darts; a text without shingles has no signature."""
    cell, owner = cells(hashes, text)
    weight = np.bincount(owner, minlength=n)
    has = weight > 0
    top = np.ceil(np.log2((k * math.log(k) + 2 * k) / np.maximum(weight, 1))).astype(int)  # bands below 2**top are looked at
    best_rank, best = np.full(n * k, np.inf), np.zeros(n * k, dtype=np.uint64)
    band, todo = FLOOR - 1, has.copy()
    while todo.any():
        here = todo[owner]
        t, at, rank, dart = _darts(cell[here], owner[here], band, k)
        key = t * k + at
        order = np.lexsort((dart, rank, key))
        key, rank, dart = key[order], rank[order], dart[order]
        lead = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
        better = lead[rank[lead] < best_rank[key[lead]]]
        best_rank[key[better]], best[key[better]] = rank[better], dart[better]
        band += 1
        # a text is done once its bands reach the expected height and no coordinate is empty
        todo &= (band < top) | np.isinf(best_rank).reshape(n, k).any(axis=1)
    return best.reshape(n, k), has


def band_names(signature: np.ndarray) -> np.ndarray:
    """A name for the rows of each band."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        out = name_pair(out, rows[:, :, r], 13)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two documents given as (distinct shingles sorted, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [_bytes(t) for t in b["text"]]
        for i, j in common.in_chunks(np.array([len(t) // 5 for t in texts]), CHUNK):
            sig, has = signatures(*shingles(texts[i:j]), j - i)
            names = band_names(sig).view(np.int64)
            yield pd.DataFrame({"key": b["key"].iloc[i:j].to_numpy(), "digest": b["digest"].iloc[i:j].to_numpy(), "bands": [names[r] if has[r] else None for r in range(j - i)]})


def _verify(threshold: float):
    """Pairs of a pivot and its members that are similar enough; rows come sorted by group, each group's pivot first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pivot = None, None
        for b in batches:
            out = []
            for i, j in common.in_chunks(np.array([len(t) // 5 for t in b["text"]]), CHUNK):
                part = b.iloc[i:j]
                h, owner = shingles([_bytes(t) for t in part["text"]])
                cut = np.searchsorted(owner, np.arange(len(part) + 1))
                for r, (group, salt, digest, member) in enumerate(zip(part["pivot"], part["salt"], part["digest"], part["member"])):
                    own = np.unique(h[cut[r] : cut[r + 1]], return_counts=True)
                    if not member:
                        at, pivot = (group, salt), own
                    elif at == (group, salt) and similarity(pivot, own) >= threshold:
                        out.append((group, digest))
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (pivot, digest) that are similar enough: members travel to their pivot, at most GROUP or so at a time."""
    sizes = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    salted = common.staged(pairs.join(sizes, "pivot").select("pivot", "digest", F.expr(f"pmod(xxhash64(digest), cast(ceil(n / {GROUP}) as bigint))").alias("salt")), "pairs")
    wanted = salted.select("pivot", "salt", "digest", F.lit(True).alias("member")).unionByName(
        salted.select("pivot", "salt").distinct().select("pivot", "salt", F.col("pivot").alias("digest"), F.lit(False).alias("member")))
    n = common.partitions(texts)
    rows = wanted.join(texts, "digest").select("pivot", "salt", "member", "digest", "text").repartition(n, "pivot", "salt").sortWithinPartitions("pivot", "salt", "member")
    return rows.mapInPandas(_verify(threshold), "a binary, b binary")


class _Held:
    """A block of texts as sets of cells, and what tells whether a pair of theirs is to be compared here."""

    def __init__(self) -> None:
        self.cells, self.digests, self.roots, self.bands = [], [], [], []
        self.names = None

    def add(self, cell: np.ndarray, digest: bytes, root: bytes, bands: np.ndarray) -> None:
        for to, x in zip((self.cells, self.digests, self.roots, self.bands), (cell, digest, root, bands)):
            to.append(x)

    def similar(self, band: int, common_root: bool, cell: np.ndarray, digest: bytes, root: bytes, bands: np.ndarray, threshold: float) -> list[bytes]:
        """Held texts similar to the given one; of two texts that are both held somewhere the lesser digest asks, in the first band that they share."""
        if self.names is None:
            self.names, self.at = np.unique(np.concatenate(self.cells), return_inverse=True)
            self.size = np.array([len(c) for c in self.cells])
            self.start = np.cumsum(self.size) - self.size
            self.band_table = np.stack(self.bands)
        wanted = ~(self.band_table[:, :band] == bands[:band]).any(axis=1)
        wanted &= np.minimum(self.size, len(cell)) >= threshold * np.maximum(self.size, len(cell)) - 1e-6  # more than that no pair can share
        wanted &= np.fromiter((r != root and (common_root or d < digest) for r, d in zip(self.roots, self.digests)), bool, len(self.roots))
        if not wanted.any():
            return []
        mark = np.zeros(len(self.names), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.names, cell), len(self.names) - 1)
        mark[at[self.names[at] == cell]] = 1
        shared = np.add.reduceat(mark[self.at], self.start)
        return [self.digests[i] for i in np.flatnonzero(wanted & (shared / (self.size + len(cell) - shared) >= threshold))]


def _compare(threshold: float):
    """Pairs of held and passing texts that are similar enough; rows come sorted by group, each group's held texts first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, _Held()
        for b in batches:
            out = []
            for i, j in common.in_chunks(np.array([len(t) // 5 for t in b["text"]]), CHUNK):
                part = b.iloc[i:j]
                cell, owner = cells(*shingles([_bytes(t) for t in part["text"]]))
                cut = np.searchsorted(owner, np.arange(len(part) + 1))
                for r, (band, name, block, salt, passing, common_root, digest, root, bands) in enumerate(zip(*(part[c] for c in ("band", "name", "block", "salt", "passing", "common", "digest", "root", "bands")))):
                    if at != (band, name, block, salt):
                        at, held = (band, name, block, salt), _Held()
                    own = cell[cut[r] : cut[r + 1]]
                    if not passing:
                        held.add(own, digest, root, bands)
                    elif held.cells:
                        out += [(digest, other) for other in held.similar(band, common_root, own, digest, root, bands, threshold)]
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _all_pairs(members: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs among ``members`` (band, name, digest, root) that share a bucket and differ in root, none left out.

    All texts of a bucket but those of its commonest root are held, in blocks; every text of the bucket passes by each
    block. So a few strays in a bucket of a large class cost a pass of the class, and only texts that are truly
    apart cost the square of their number, in rows divided by BLOCK.
    """
    bucket = ["band", "name"]
    sized = common.staged(members.join(texts.select("digest", F.octet_length("text").alias("bytes")), "digest"), "open")
    by_root = sized.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    all_of = by_root.groupBy(*bucket).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "root", "bytes")).alias("most")).where("n > most.n")
    plan = all_of.select(
        *bucket, F.col("most.root").alias("most"), F.expr(f"cast(ceil(n / {PASSING}) as int)").alias("salts"),
        F.expr(f"cast(greatest(ceil((n - most.n) / {BLOCK}), ceil((bytes - most.bytes) / {BLOCK_BYTES})) as int)").alias("blocks"))
    placed = common.staged(sized.join(plan, bucket).select(
        *bucket, "digest", "root", (F.col("root") == F.col("most")).alias("common"), "blocks", "salts",
        F.expr("cast(pmod(xxhash64(digest, 1), blocks) as int)").alias("block"), F.expr("cast(pmod(xxhash64(digest, 2), salts) as int)").alias("salt")), "placed")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["common", "digest", "root"]
    held = placed.where("not common").select(*bucket, "block", each("salts").alias("salt"), F.lit(False).alias("passing"), *rest)
    passing = placed.select(*bucket, each("blocks").alias("block"), "salt", F.lit(True).alias("passing"), *rest)
    group = [*bucket, "block", "salt"]
    rows = held.unionByName(passing).join(texts.join(nodes.select("digest", "bands"), "digest"), "digest").select(*group, "passing", *rest, "bands", "text")
    n = common.partitions(texts)
    return rows.repartition(n, *group).sortWithinPartitions(*group, "passing").mapInPandas(_compare(threshold), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, class_id, class_size, kept, digest).

    Documents whose weighted Jaccard similarity over shingles of five lower-cased words is ``threshold`` or more are
    linked, as are equal texts; classes are what links connect. ``class_id`` is the class's least id; the row with
    that id stays. Equal texts are one node, so that a large group of copies costs what one text does. Within a band's
    bucket texts meet at the bucket's pivot; buckets whose texts end up in different classes get other pivots, band by
    band, in a second round. What a bucket then still holds of different classes is compared pair by pair. A link is
    lost only where a pair shares no bucket of 26 and no chain of links joins its ends.

    Nulls: a null id is a row of its own unless its text equals another's; it is kept where its class has no id at
    all. Null, empty and blank texts have no shingles and are linked to equal texts only (null counts as empty).
    Rows that repeat an id and text are one document: each counts, and they share ``kept``. An empty table gives an
    empty result; extra columns are not read.
    """
    common.short_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"))
    # what stands for a row where its text is looked up: its id, or its digest where it has none
    keyed = base.select("id", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("~"), F.hex("digest"))).alias("key"), "digest", "text")
    signed = common.staged(keyed.select("key", "digest", "text").mapInPandas(_sign, "key string, digest binary, bands array<bigint>"), "signatures")
    nodes = common.staged(signed.groupBy("digest").agg(F.min_by("bands", "key").alias("bands"), F.min("key").alias("key")), "nodes")
    in_band = common.staged(nodes.where("bands is not null").select("digest", F.posexplode("bands").alias("band", "name")), "bands")

    low = in_band.groupBy("band", "name").agg(F.min("digest").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "name", "pivot")
    met = common.staged(in_band.join(low, ["band", "name"]), "buckets")
    pairs = common.staged(met.where("digest <> pivot").select("pivot", "digest").distinct(), "candidates")
    involved = met.select("digest").distinct()
    chosen = nodes.join(involved, "digest", "left_semi").select("key", "digest")
    texts = common.staged(keyed.select("key", "digest", "text").join(chosen, ["key", "digest"]).select("digest", "text"), "texts")
    links = common.staged(_verified(pairs, texts, threshold), "links")
    label = common.staged(connected(links), "classes")

    # texts that met in a bucket and are in different classes yet: they meet again, at a pivot that differs by band
    of = met.join(label, met["digest"] == label["node"], "left").select("band", "name", "digest", F.coalesce("root", "digest").alias("root"))
    mixed = common.staged(of.groupBy("band", "name").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct("digest", "root"), F.xxhash64("digest", "band")).alias("p")).where("low <> high"), "mixed")
    second = of.join(mixed, ["band", "name"]).where(F.col("root") != F.col("p.root")).select(F.col("p.digest").alias("pivot"), "digest").distinct()
    second = common.staged(second.join(pairs, ["pivot", "digest"], "left_anti").join(pairs.select(F.col("digest").alias("pivot"), F.col("pivot").alias("digest")), ["pivot", "digest"], "left_anti"), "candidates")
    if not second.isEmpty():
        more = common.staged(_verified(second, texts, threshold), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            label = common.staged(connected(links), "classes")

    # pairs that are open yet: both pivots of a bucket have met all of it that was in other classes
    others = met.join(mixed.select("band", "name", F.col("p.digest").alias("p")), ["band", "name"]).where("digest <> pivot and digest <> p")
    left = common.staged(others.join(label, others["digest"] == label["node"], "left").select("band", "name", "digest", F.coalesce("root", "digest").alias("root")), "left")
    apart = left.groupBy("band", "name").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "name")
    members = common.staged(left.join(apart, ["band", "name"], "left_semi"), "members")
    if not members.isEmpty():
        more = common.staged(_all_pairs(members, nodes, texts, threshold), "links")
        if not more.isEmpty():
            label = common.staged(connected(links.unionByName(more)), "classes")

    rows = base.select("id", "digest")
    classed = rows.join(label, rows["digest"] == label["node"], "left").select("id", "digest", F.coalesce("root", rows["digest"]).alias("root"))
    sizes = classed.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return classed.join(sizes, "root").select(
        F.col("id").alias("doc_id"), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), F.lower(F.hex("digest")).alias("digest"))
