"""SimHash near-duplicates through an inverted index of byte positions, with count filtering.

A fingerprint has eight bytes, and a posting (position, value) holds the fingerprints with that byte there. Two
fingerprints that differ in at most four bits differ in at most four bytes, so they stand together in at least four
postings: pairs are tallied by the positions at which they share a posting, pairs that reach the minimum are verified by
their bits. One posting of 256 values a position is too long for a task, so postings are read in intersections: of any
four positions out of eight two lie in one of the groups {0,1,2}, {3,4,5}, {6,7}, so the seven pairs of positions inside
these groups are enough for a pair to meet. Where an intersection of two postings is long, its fingerprints go to the
intersections of four postings instead, of which every pair of the minimum shares one; and what is long even there is
compared in tiles of two blocks, so no pair is lost to a bound.

Rows with one fingerprint are one node from the start. A task passes on what its links connect, not the links, so a dense
group of m fingerprints leaves it as m - 1 rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected

SHINGLE, SEED = 4, 42
#: Fingerprints link at this many differing bits or fewer; then at least 8 - BITS of their bytes agree in place.
BITS = 4
MATCHES = 8 - BITS
#: Pairs of positions of which any four positions hold one: all pairs inside three groups.
PAIRS = [p for group in ((0, 1, 2), (3, 4, 5), (6, 7)) for p in combinations(group, 2)]
#: Fingerprints of one intersection that are compared with one another in a task, and rows that a task looks at together.
LONG, ROWS = 2048, 1 << 16
#: Hashes whose bits are counted at a time.
HASHES = 1 << 14


def fingerprint(text: str | None) -> int:
    """The SimHash of a text: a bit is 1 if it is set in more than half of the hashes of its runs of four words.

    Only A-Z is lower-cased; words are parted by space and \\t-\\r. Fewer words are one run; none give 0.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate(([0], end[:-1] + 1))
    n = max(len(words) - SHINGLE + 1, 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin[:n].tolist(), end[-n:].tolist())), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, HASHES):
        part = hashes[k : k + HASHES].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        marks = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64)
        yield pd.DataFrame({"key": b["key"].to_numpy(), "mark": marks.view(np.int64)})


class _Union:
    """Connected components of row numbers, joined many pairs at a time."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            x = y

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def linked(marks: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the pairs of fingerprints share enough bytes in place and differ in few enough bits."""
    differ = marks ^ other
    shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    near = shared >= MATCHES
    near[near] = np.bitwise_count(differ[near]) <= BITS
    return near


def _stars(marks: np.ndarray, union: _Union) -> pd.DataFrame:
    root = union.roots(np.arange(len(marks)))
    held = np.flatnonzero(root != np.arange(len(marks)))
    own, low = marks[held], marks[root[held]]
    apart = own != low
    return pd.DataFrame({"a": low[apart].view(np.int64), "b": own[apart].view(np.int64)})


def _within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the fingerprints of each intersection connect; rows come sorted by (mask, value)."""
    for b in common.whole_groups(batches, ["mask", "value"], ROWS):
        marks = b["mark"].to_numpy().view(np.uint64)
        new = np.concatenate(([True], (b["mask"].to_numpy()[1:] != b["mask"].to_numpy()[:-1]) | (b["value"].to_numpy()[1:] != b["value"].to_numpy()[:-1])))
        last = np.append(np.flatnonzero(new)[1:], len(b))[np.cumsum(new) - 1]  # where each row's group ends
        union, at, step = _Union(len(b)), np.arange(len(b)), 1
        while len(at := at[at + step < last[at]]):
            near = at[linked(marks[at], marks[at + step])]
            union.join(near, near + step)
            step += 1
        yield _stars(marks, union)


def _tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What two blocks of one intersection connect: each row has both blocks' fingerprints as bytes."""
    for b in batches:
        for x, y in zip(b["x"], b["y"]):
            x, y = (np.frombuffer(z, dtype="<u8").astype(np.uint64) for z in (x, y))
            both, union = np.concatenate([x, y]), _Union(len(x) + len(y))
            for i in range(len(x)):
                near = np.flatnonzero(linked(np.full(len(y), x[i]), y))
                union.join(np.full(len(near), i), len(x) + near)
            yield _stars(both, union)


def _mask(positions: tuple[int, ...]) -> int:
    """The bits of the bytes at the given positions, as a signed long."""
    return int(np.array([sum(0xFF << (8 * k) for k in positions)], dtype=np.uint64).view(np.int64)[0])


def _postings(marks: DataFrame, positions: list[tuple[int, ...]]) -> DataFrame:
    """(mask, value, mark): each fingerprint in the intersections of its postings at the given positions."""
    each = F.explode(F.array([F.lit(_mask(p)) for p in positions]))
    return marks.select(each.alias("mask"), "mark").select("mask", F.col("mark").bitwiseAND(F.col("mask")).alias("value"), "mark")


def _dealt(rows: DataFrame) -> DataFrame:
    n = common.partitions(rows)
    return rows.repartition(n, "mask", "value").sortWithinPartitions("mask", "value").mapInPandas(_within, "a long, b long")


def _sized(rows: DataFrame, label: str, long: int) -> tuple[DataFrame, DataFrame]:
    """The rows (mask, value, mark) of short intersections, and those of long ones."""
    sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = common.staged(rows.join(sizes.where("n > 1"), ["mask", "value"]), label)
    return rows.where(F.col("n") <= long).drop("n"), rows.where(F.col("n") > long)


def links(marks: DataFrame, long: int = LONG) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints ``marks`` (mark long) that connect whatever links of BITS bits or fewer connect.

    ``long`` bounds what one task compares at once, not what is compared.
    """
    short, more = _sized(_postings(marks, PAIRS), "postings", long)
    found = [_dealt(short)]
    if not more.isEmpty():
        # in an intersection of two postings every pair to find shares two postings more
        wider = lambda p: [(*p, *q) for q in combinations(sorted(set(range(8)) - {*p}), MATCHES - 2)]
        fours = _all([_postings(more.where(F.col("mask") == _mask(p)).select("mark"), wider(p)) for p in PAIRS]).distinct()
        short, most = _sized(fours, "postings", long)
        found.append(_dealt(short))
        if not most.isEmpty():
            found.append(_tiles(most, long))
    return common.staged(_all(found).distinct(), "links")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _tiles(rows: DataFrame, long: int) -> DataFrame:
    """Intersections that are too long for a task, in blocks of about ``long`` fingerprints; every two blocks meet in a tile."""
    group = ["mask", "value"]
    blocks = F.ceil(F.col("n") / long).cast("int")
    dealt = rows.select(*group, blocks.alias("blocks"), F.pmod(F.xxhash64("mark"), blocks).cast("int").alias("block"), "mark")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return part[[*group, "blocks", "block"]].iloc[:1].assign(marks=[part["mark"].to_numpy(dtype="<i8").tobytes()])

    packed = common.staged(dealt.groupBy(*group, "block").applyInPandas(pack, "mask long, value long, blocks int, block int, marks binary"), "blocks")
    left = packed.select(*group, F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"), F.col("marks").alias("x"))
    right = packed.select(*group, F.col("block").alias("other"), F.col("marks").alias("y"))
    met = left.join(right, [*group, "other"]).select("x", "y")
    return met.repartition(common.partitions(met)).mapInPandas(_tile, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """One row per input row: (doc_id, fingerprint, component_id).

    Fingerprints are 64-bit SimHashes over runs of four words (``fingerprint``), in 16 lowercase hexadecimal digits.
    Rows link where their fingerprints differ in at most four bits; ``component_id`` is the least id that links reach.

    Nulls: a null or empty or blank text has fingerprint 0 and links like any other. A null id is no component's name:
    where a component has no id at all, its name is null. Rows that repeat are rows of their own, in one component. An
    empty table gives an empty result; extra columns are not read. Texts may be of any length: hashes of a text are
    held as eight bytes a word, their bits counted some thousands at a time.
    """
    common.short_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    kind = own.schema["key"].dataType  # as text on its way through Python: pandas has no whole numbers with nulls
    signed = common.staged(own.withColumn("key", F.col("key").cast("string")).mapInPandas(_sign, "key string, mark long").select(F.col("key").cast(kind).alias("key"), "mark"), "fingerprints")
    nodes = common.staged(signed.groupBy("mark").agg(F.min("key").alias("low")), "nodes")
    label = connected(links(nodes.select("mark"), long))
    classed = nodes.join(label, nodes["mark"] == label["node"], "left").select("mark", "low", F.coalesce("root", "mark").alias("root"))
    names = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    of = classed.join(names, "root").select("mark", "component_id")
    return signed.join(of, "mark").select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
