"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of like size are put together in blocks. A block has a row for each bit of a Bloom filter and a column for each
document: the filter of a document holds its terms, and for terms that occur at least 2, 3, 5, 9 ... times an entry of
that level, too. The rows at a term's bits, combined by AND, are a bitmap of the block's documents that may hold the term
so often; a filter errs on the side of more only. So a document's bitmaps bound how often it holds each term, its length
is known exactly, and the weighted sum over an item's terms is an upper bound of its score.

A first pass over the blocks takes the documents with the highest bounds and scores them exactly; the least of an item's
``k`` best exact scores is a floor of its results. A second pass takes every document whose bound reaches the floor:
the others are proven to be no result. These are scored exactly from their whole texts. No document is sampled or capped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textkit

#: Bits a filter has for each entry at least, bits that an entry sets, and bits of one block.
WIDTH, PROBES, BLOCK_BITS = 12, 6, 1 << 23
#: The least number of occurrences of each level; a term without the entry of the next level occurs less often than that.
LEVELS = [1, 2, *(2**k + 1 for k in range(1, 20))]
#: Bytes of text whose terms are counted at a time, and cells of terms and documents that are bounded at a time.
CHUNK, CELLS = 1 << 22, 1 << 21
#: Terms of the items that are looked up in one pass over the blocks, or so; more items are searched for in as many passes.
MAX_TERMS = 50_000
#: Documents of the highest bounds that give an item's floor, in units of ``k``.
SEEDS = 2
#: Candidates are broadcast up to this number of rows (some 30 MB); beyond it the join with the texts shuffles.
BROADCAST_CANDIDATES = 500_000
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of terms, with A-Z lower-cased; all others part terms.
AS_TERM = np.array([b + 32 if 65 <= b <= 90 else b if TERM.match(bytes([b])) else 32 for b in range(256)], dtype=np.uint8)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of letters and digits, where any character outside ASCII counts as a letter."""
    return TERM.findall(_bytes(text).lower())


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of each distinct term of each text, sorted by text and term, and the number of terms of each text."""
    buffer, starts = textkit.joined(texts)
    names, _, _, of_text = textkit.word_hashes(AS_TERM[buffer], starts)
    n = np.diff(of_text)
    text = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((names, text))
    names, text = names[order], text[order]
    first = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (text[1:] != text[:-1])))) if len(names) else np.zeros(0, int)
    return text[first], names[first], np.diff(np.append(first, len(names))), n


def entries(text: np.ndarray, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, entry): an entry for each level that a term reaches."""
    out = []
    for level, least in enumerate(LEVELS):
        has = times >= least
        if not has.any():
            break
        out.append((text[has], leveled(term[has], level)))
    return np.concatenate([x for x, _ in out] or [np.zeros(0, int)]), np.concatenate([x for _, x in out] or [np.zeros(0, np.uint64)])


def leveled(term: np.ndarray, level: int) -> np.ndarray:
    return textkit.mix(term + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) if level else term


def bits(entry: np.ndarray, width: int) -> np.ndarray:
    """PROBES rows of a filter of ``width`` (a power of two times WIDTH) bits for each entry."""
    a, b = textkit.mix(entry), textkit.mix(entry ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(width)).astype(np.int64)


class _Block:
    """Documents of one size class that wait for their block."""

    def __init__(self, size_class: int) -> None:
        self.width = WIDTH << size_class
        self.most = max(1, min(4096, BLOCK_BITS // self.width // 8 * 8))
        self.keys, self.lengths, self.entries = [], [], []

    def packed(self) -> dict:
        n = len(self.keys)
        grid = np.zeros((self.width, n), dtype=bool)
        column = np.repeat(np.arange(n), [len(e) for e in self.entries])
        rows = bits(np.concatenate(self.entries), self.width)
        for p in range(PROBES):
            grid[rows[:, p], column] = True
        return {"width": self.width, "keys": np.array(self.keys, dtype="<i8").tobytes(), "lengths": np.array(self.lengths, dtype="<i8").tobytes(), "slices": np.packbits(grid, axis=1).tobytes()}


def _scan(watched: np.ndarray, with_blocks: bool):
    """Blocks of documents, and in how many documents each of the watched terms is; watched terms are sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[int, _Block] = {}
        found = np.zeros(len(watched), dtype=np.int64)
        rows = lambda made: pd.DataFrame([{"width": None, "keys": None, "lengths": None, "slices": None, "at": None, "df": None} | r for r in made])
        for b in batches:
            texts, made = [_bytes(t) for t in b["text"]], []
            for i, j in common.in_chunks(np.array([len(t) for t in texts]), CHUNK):
                text, term, times, n = counted(texts[i:j])
                at = np.minimum(np.searchsorted(watched, term), max(len(watched) - 1, 0))
                if len(watched):
                    np.add.at(found, at[watched[at] == term], 1)
                if not with_blocks:
                    continue
                text, entry = entries(text, term, times)
                order = np.argsort(text, kind="stable")
                entry, cut = entry[order], np.searchsorted(text[order], np.arange(j - i + 1))
                for r in np.flatnonzero(n):
                    own = entry[cut[r] : cut[r + 1]]
                    size_class = int(len(own)).bit_length()
                    block = open_.setdefault(size_class, _Block(size_class))
                    block.keys.append(b["key"].iloc[i + r])
                    block.lengths.append(n[r])
                    block.entries.append(own.copy())
                    if len(block.keys) >= block.most:
                        made.append(open_.pop(size_class).packed())
            if made:
                yield rows(made)
        for size_class in sorted(open_):
            yield rows([open_[size_class].packed()])
        some = np.flatnonzero(found)
        if len(some):
            yield rows([{"at": some.tolist(), "df": found[some].tolist()}])

    return run


_SCANNED = "width long, keys binary, lengths binary, slices binary, at array<int>, df array<long>"


class _Weights:
    """The items of one pass: their distinct terms with weights, and which of them each item has."""

    def __init__(self, names: np.ndarray, weight: np.ndarray, items: list[np.ndarray], n_docs: int, n_terms: int) -> None:
        self.names, self.weight, self.items, self.n_docs, self.n_terms = names, weight, items, n_docs, n_terms

    def part(self, weight: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term adds to a document's score, in whole numbers."""
        m = 10 + 90 * length * self.n_docs // self.n_terms
        return weight * (1_000_000_000 * times // (1000 * times + 8 * m))

    def bounds(self, width: int, lengths: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """For each item and document of a block the most that the document's score can be."""
        out = np.zeros((len(self.items), len(lengths)), dtype=np.int64)
        step = max(8, CELLS // max(len(self.names), 1) // 8 * 8)
        for lo in range(0, len(lengths), step):
            gain = self._gains(width, lengths[lo : lo + step], slices[:, lo // 8 : (lo + step) // 8])
            for i, own in enumerate(self.items):
                out[i, lo : lo + step] = gain[own].sum(axis=0)
        return out

    def _gains(self, width: int, lengths: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """For each term and document the most that the term can add."""
        n = len(lengths)
        row, held = np.arange(len(self.names)), None
        most = np.zeros((len(self.names), n), dtype=np.int64)  # how often at most
        for level in range(len(LEVELS)):
            at = bits(leveled(self.names[row], level), width)
            hit = slices[at[:, 0]] if held is None else slices[at[:, 0]] & held
            for p in range(1, PROBES):
                hit &= slices[at[:, p]]
            some = hit.any(axis=1)
            row, held = row[some], hit[some]
            if not len(row):
                break
            i, j = np.nonzero(np.unpackbits(held, axis=1, count=n))
            most[row[i], j] = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else lengths[j]
        i, j = np.nonzero(most)
        most[i, j] = self.part(self.weight[i], np.minimum(most[i, j], lengths[j]), lengths[j])
        return most


def _block_of(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, lengths = (np.frombuffer(x, dtype="<i8") for x in (r.keys, r.lengths))
    return keys, lengths, np.frombuffer(r.slices, dtype=np.uint8).reshape(int(r.width), -1)


def _best(w: _Weights, most: int):
    """The documents of the highest bounds of each item, ``most`` from each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bound = np.zeros((len(w.items), 0), dtype=np.int64)
        key = np.zeros((len(w.items), 0), dtype=np.int64)
        for b in batches:
            for r in b.itertuples():
                keys, lengths, slices = _block_of(r)
                bound = np.hstack([bound, w.bounds(int(r.width), lengths, slices)])
                key = np.hstack([key, np.broadcast_to(keys, (len(w.items), len(keys)))])
                if bound.shape[1] > most:
                    top = np.argpartition(bound, bound.shape[1] - most, axis=1)[:, -most:]
                    bound, key = np.take_along_axis(bound, top, axis=1), np.take_along_axis(key, top, axis=1)
        i, j = np.nonzero(bound)
        yield pd.DataFrame({"item": i, "key": key[i, j], "bound": bound[i, j]})

    return run


def _reaching(w: _Weights, floor: np.ndarray):
    """Every document whose bound reaches its item's floor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                keys, lengths, slices = _block_of(r)
                i, j = np.nonzero(w.bounds(int(r.width), lengths, slices) >= floor[:, None])
                yield pd.DataFrame({"item": i, "key": keys[j]})

    return run


def _scores(w: _Weights, words: list[list[bytes]]):
    """Exact scores of documents against the items that they are candidates for, from whole texts and whole terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r, (text, wanted) in enumerate(zip(b["text"], b["wanted"])):
                counts: dict[bytes, int] = {}
                known = {t for i in wanted for t in words[i]}
                n = 0
                for t in TERM.finditer(_bytes(text).lower()):
                    n += 1
                    if (t := t.group()) in known:
                        counts[t] = counts.get(t, 0) + 1
                for i in wanted:
                    has = [(k, counts[t]) for k, t in zip(w.items[i], words[i]) if t in counts]
                    score = int(w.part(w.weight[[k for k, _ in has]], np.array([c for _, c in has]), np.array([n])).sum()) if has else 0
                    if score > 0:
                        out.append((b["doc_id"].iloc[r], int(i), score))
            yield pd.DataFrame(out, columns=["doc_id", "item", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item with a score above 0, ties by ascending id.

    With N documents that have a term at all, L terms in all of them and df documents that hold a term, its weight is
    floor(1000 ln((2N+2)/(2df+1))). A document of n terms has m = 10 + (90 n N) div L, and a term that occurs tf times
    in it adds weight * ((10**9 tf) div (1000 tf + 8 m)); an item's terms count once each.

    Nulls: null, empty and blank texts have no terms; such documents are in no count and no result, such items have no
    results. A null document id comes last among equal scores. Every row is a document: rows that repeat count each.
    Rows of items that repeat an id and a set of terms are one item; an item id with other terms is ranked by itself,
    under the same id. Empty tables give an empty result; extra columns are not read. A text of any length is counted
    whole.
    """
    spark = docs.sparkSession
    common.short_batches(spark)
    id_type, item_type = (df.schema[c].dataType for df, c in ((docs, id_col), (items, item_id_col)))
    text = F.col(f"`{text_col}`")
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"))
    n_terms = items.select(F.col(f"`{item_id_col}`").cast("string").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).mapInPandas(_item_terms, "item_id string, words array<binary>").distinct()
    wanted = common.staged(n_terms, "items").where(F.size("words") > 0)
    parts = -(-(wanted.agg(F.sum(F.size("words"))).first()[0] or 0) // MAX_TERMS)
    blocks, found = None, []
    for p in range(parts):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == p).collect()  # MAX_TERMS terms or so
        ids, words = [r["item_id"] for r in rows], [[bytes(x) for x in r["words"]] for r in rows]
        if not ids:
            continue
        every = sorted({t for ws in words for t in ws})
        names = textkit.word_hashes(*textkit.joined(every))[0]
        by_name = np.argsort(names)
        scanned = common.staged(own.select("key", "text").mapInPandas(_scan(names[by_name], blocks is None), _SCANNED), "blocks")
        if blocks is None:
            blocks = scanned.where("slices is not null").select("width", "keys", "lengths", "slices")
            n_docs, total = _totals(blocks)
        if not total:
            break
        df = np.zeros(len(names), dtype=np.int64)
        for r in scanned.where("at is not null").select(F.explode(F.arrays_zip("at", "df")).alias("x")).groupBy("x.at").agg(F.sum("x.df").alias("df")).collect():  # a row for each term
            df[by_name[r["at"]]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        number = {t: i for i, t in enumerate(every)}
        w = _Weights(names, weight, [np.array([number[t] for t in ws]) for ws in words], n_docs, total)
        found.append(_ranked(own, blocks, w, words, ids, k))
    if not found:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {id_type.simpleString()}, score long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("item_id").cast(item_type).alias("item_id"), "rank", F.col("doc_id").cast(id_type).alias("doc_id"), "score")


def _item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"item_id": b["item_id"], "words": [sorted(set(terms(t))) for t in b["text"]]})


def _totals(blocks: DataFrame) -> tuple[int, int]:
    """The number of documents with terms, and of all their terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [len(x) // 8 for x in b["keys"]], "total": [int(np.frombuffer(x, dtype="<i8").sum()) for x in b["lengths"]]})

    n, total = blocks.select("keys", "lengths").mapInPandas(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return n or 0, total or 0


def _ranked(own: DataFrame, blocks: DataFrame, w: _Weights, words: list[list[bytes]], ids: list[str | None], k: int) -> DataFrame:
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "key")
    seeds = blocks.mapInPandas(_best(w, SEEDS * k), "item int, key long, bound long").withColumn("r", F.row_number().over(by_bound)).where(F.col("r") <= SEEDS * k)
    first = _exact(own, common.staged(seeds.select("item", "key").distinct(), "seeds"), w, words)
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("r") == k)
    floor = np.ones(len(w.items), dtype=np.int64)
    for r in best.select("item", "score").collect():  # a row for each item
        floor[r["item"]] = r["score"]
    near = common.staged(blocks.mapInPandas(_reaching(w, floor), "item int, key long").distinct(), "candidates")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = _exact(own, near, w, words).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = own.sparkSession.createDataFrame(list(enumerate(ids)), "item int, item_id string")
    return top.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # a row for each item of a pass


def _exact(own: DataFrame, near: DataFrame, w: _Weights, words: list[list[bytes]]) -> DataFrame:
    """(item, doc_id, score) of the candidates (item, key); a document's text is read once, for all its items of this pass."""
    wanted = common.staged(near.groupBy("key").agg(F.collect_list("item").alias("wanted")), "wanted")
    kind = own.schema["doc_id"].dataType
    rows = own.join(common.if_small(wanted, BROADCAST_CANDIDATES), "key").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "wanted")
    scored = rows.mapInPandas(_scores(w, words), "doc_id string, item int, score long")
    return common.staged(scored.select(F.col("doc_id").cast(kind).alias("doc_id"), "item", "score"), "scores")
