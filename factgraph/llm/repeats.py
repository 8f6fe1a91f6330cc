"""Windows of a fixed number of units (words or bytes) that occur more than once, decided exactly at scale.

Every window has one anchor, a position chosen by a rule that looks at the window's content alone, so equal
windows have their anchors at the same place and each window is looked at once. Then:

1. each anchor with the windows that chose it becomes one or two rows, named by the content (the core) that all these
   windows share: about a row for every ten words, or 120 bytes;
2. rows whose core is named nowhere else go (a count with partial sums, then a join that may be split by skew);
3. of the others the text to both sides of the core is cut out, and rows with equal cores (128-bit names) meet in
   one task, where every window is compared with all others of its class by its offset and its sides;
4. classes with many rows (a passage in thousands of documents) don't meet: rows with the same text on both sides
   become one context first, with partial sums; contexts of a class meet if they are few, else each of their windows
   is counted by its own 128-bit name; runs of repeated windows then return to the contexts' rows;
5. runs of repeated windows are spans, which return to their documents.

Nothing is capped or sampled, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .textkit import BASES, Spans, mix, name_pair

#: Units handled at a time within a task; a longer text is handled alone.
CHUNK = 1 << 20
#: Rows of a class that meet in one task at most.
HOT = 4_000
#: Rows of a context that travel as one list.
PACKED = 256
#: Low bits of a packed name that hold a place, and the units of a text that are looked at together: longer texts are looked at in segments.
PLACE, LONG = np.uint64(26), 1 << 24


def pack(names: np.ndarray) -> np.ndarray:
    """Names with their places in the low bits: the smallest is the smallest name, of equal ones the leftmost."""
    return (names >> PLACE << PLACE) | np.arange(len(names), dtype=np.uint64)


def place(packed: np.ndarray) -> np.ndarray:
    return (packed & np.uint64((1 << 26) - 1)).astype(np.int64)


def range_min(packed: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of ``packed[begin:end]`` for each pair of bounds; no range is empty."""
    out = np.empty(len(begin), dtype=np.uint64)
    width = end - begin
    level, size = packed, 1
    while True:
        fits = np.flatnonzero((width >= size) & (width < 2 * size))
        if len(fits):
            out[fits] = np.minimum(level[begin[fits]], level[end[fits] - size])
        if not len(width) or 2 * size > width.max():
            return out
        level, size = np.minimum(level[:-size], level[size:]), 2 * size


@dataclass
class Sites:
    """Anchors of some texts: ``at`` is chosen by the windows starting at ``first`` to ``last``; places count the units of all texts."""

    symbols: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray


@dataclass
class Units:
    """How texts are cut into units.

    ``count(text)`` is their number, ``sites(texts, window)`` gives the anchors, ``cut(text)`` a function (begin, end) -> bytes
    of a span's units, ``symbols(parts)`` the units of byte strings as (64-bit names, start of each string).
    """

    count: Callable[[bytes], int]
    sites: Callable[[list[bytes], int], Sites]
    cut: Callable[[bytes], Callable[[int, int], bytes]]
    symbols: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs in n rows, where ``same`` says for n - 1 neighbours whether they belong together."""
    cut = np.flatnonzero(~same)
    n = len(same) + 1
    return np.concatenate(([0], cut + 1)), np.concatenate((cut, [n - 1]))


def window_starts(starts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """The starts of all whole windows of texts that begin at ``starts``."""
    n = np.maximum(lengths - window + 1, 0)
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _rows(texts: list[bytes], units: Units, window: int) -> tuple[np.ndarray, ...]:
    """(text, core name, core begin, core length, first and last window start), places within the text."""
    s = units.sites(texts, window)
    half = window // 2
    near = np.maximum(s.first, s.at - half + 1)  # windows that start close before the anchor share what follows it
    far = np.minimum(s.last, s.at - half)  # the others share what precedes it
    a, b = np.flatnonzero(near <= s.last), np.flatnonzero(s.first <= far)
    begin = np.concatenate((s.at[a], s.at[b] - half))
    length = np.concatenate((np.full(len(a), window - half + 1), np.full(len(b), half + 1)))
    first, last = np.concatenate((near[a], s.first[b])), np.concatenate((s.last[a], far[b]))
    core = name_pair(Spans(s.symbols).at(begin, begin + length), length.astype(np.uint64)) if len(begin) else np.zeros(0, np.uint64)
    text = np.searchsorted(s.starts, begin, side="right") - 1
    base = s.starts[text]
    return text, core, begin - base, length, first - base, last - base


def segments(text: bytes, units: Units, window: int) -> Iterator[tuple[int, bytes]]:
    """(first unit, bytes) of segments that each window of the text lies in one of."""
    if len(text) <= LONG or (n := units.count(text)) <= LONG:
        yield 0, text
        return
    cut = units.cut(text)
    for at in range(0, n - window + 1, LONG - window + 1):
        yield at, cut(at, min(at + LONG, n))


def _emit(units: Units, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [(r, base, part) for r, t in enumerate(b["text"]) if t for base, part in segments(t.encode("utf-8", "replace"), units, window)]
            row, base = (np.array([p[k] for p in parts], dtype=np.int64) for k in (0, 1))
            for i, j in common.in_chunks(np.array([len(p[2]) for p in parts]), CHUNK):
                part, core, begin, length, first, last = _rows([p[2] for p in parts[i:j]], units, window)
                if len(part):
                    of = row[i + part]
                    yield pd.DataFrame({"core": core.view(np.int64), "id": b["id"].to_numpy()[of], "tag": b["tag"].to_numpy()[of], "begin": begin + base[i + part], "length": length, "most": begin - first, "least": begin - last})

    return run


def _sides(units: Units, window: int):
    """For each document and its rows: the 128-bit name of the core and the units to both sides."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, tag, text, rows in zip(b["id"], b["tag"], b["text"], b["rows"]):
                cut = units.cut((text or "").encode("utf-8", "replace"))
                for r in rows:
                    begin, n, most, least = r["begin"], r["length"], r["most"], r["least"]
                    out.append((blake2b(cut(begin, begin + n), digest_size=16, person=str(n).encode()).digest(), id_, tag, begin, n, most, least, cut(begin - most, begin), cut(begin + n, begin - least + window)))
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=_SIDES)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=_SIDES)

    return run


_SIDES = ["class", "id", "tag", "begin", "length", "most", "least", "left", "right"]


def _windows(b: pd.DataFrame, units: Units, window: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, name of the sides) of every window of the rows; the name tells apart windows of one class."""
    left, l_at = units.symbols(b["left"].tolist())
    right, r_at = units.symbols(b["right"].tolist())
    most, least, n = (b[k].to_numpy().astype(np.int64) for k in ("most", "least", "length"))
    count = most - least + 1
    row = np.repeat(np.arange(len(b)), count)
    offset = np.repeat(most, count) - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    l_end = l_at[:-1] + most
    names = Spans(left, base).at(l_end[row] - offset, l_end[row])
    r_begin = r_at[:-1][row]
    names = name_pair(names, Spans(right, base).at(r_begin, r_begin + window - offset - n[row]))
    return row, offset, name_pair(names, offset.astype(np.uint64), 1)


def _judge(units: Units, window: int, earlier: bool):
    """Spans of the repeated windows of whole classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in common.whole_groups(batches, ["class"], 10_000):
            group = pd.factorize(b["class"])[0]
            if earlier:
                order = np.argsort(b["id"].to_numpy(), kind="stable")
                b, group = b.iloc[order].reset_index(drop=True), group[order]
            row, offset, names = _windows(b, units, window, BASES[0])
            names = name_pair(names, group[row].astype(np.uint64))
            _, at, which, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
            ids = b["id"].to_numpy()
            hit = ids[row] > ids[row[at[which]]] if earlier else counts[which] > 1
            row, offset = row[hit], offset[hit]
            if not len(row):
                continue
            i, j = runs((row[1:] == row[:-1]) & (offset[1:] == offset[:-1] - 1))
            begin = b["begin"].to_numpy()[row[i]]
            yield pd.DataFrame({"id": ids[row[i]], "tag": b["tag"].to_numpy()[row[i]], "from": begin - offset[i], "to": begin - offset[j] + window})

    return run


def _judge_contexts(units: Units, window: int, earlier: bool):
    """Runs of repeated windows (context, most, least, low) of whole classes of contexts, which stand for n rows with ids from low to high."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in common.whole_groups(batches, ["class"], 10_000):
            row, offset, names = _windows(b, units, window, BASES[0])
            names = name_pair(names, pd.factorize(b["class"])[0][row].astype(np.uint64))
            _, which = np.unique(names, return_inverse=True)
            if earlier:
                low = b["low"].to_numpy()[row]
                order = np.lexsort((low, which))
                lead = np.concatenate(([True], which[order][1:] != which[order][:-1]))
                low = low[order][lead][which]
                hit = low < b["high"].to_numpy()[row]
            else:
                low = np.zeros(len(row), dtype=np.int64)
                hit = np.bincount(which, weights=b["n"].to_numpy()[row])[which] > 1
            row, offset, low = row[hit], offset[hit], low[hit]
            if len(row):
                i, j = runs((row[1:] == row[:-1]) & (offset[1:] == offset[:-1] - 1) & (low[1:] == low[:-1]))
                yield pd.DataFrame({"context": b["context"].to_numpy()[row[i]], "most": offset[i], "least": offset[j], "low": low[i]})

    return run


def _named_windows(units: Units, window: int):
    """Every window of contexts that are too many to meet, under a 128-bit name of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 5_000):
                b = whole.iloc[at : at + 5_000].reset_index(drop=True)
                key = np.frombuffer(b"".join(b["class"]), dtype=np.uint64).reshape(-1, 2)
                row, offset, a = _windows(b, units, window, BASES[0])
                _, _, c = _windows(b, units, window, BASES[1])
                yield pd.DataFrame({"a": name_pair(key[row, 0], a).view(np.int64), "c": name_pair(key[row, 1], mix(c)).view(np.int64), "context": b["context"].to_numpy()[row], "offset": offset, "n": b["n"].to_numpy()[row], "low": b["low"].to_numpy()[row], "high": b["high"].to_numpy()[row]})

    return run


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one context as lists."""
    for b in common.gathered(batches, 100_000):
        order = np.argsort(pd.factorize(b["context"])[0], kind="stable")
        context = b["context"].to_numpy()[order]
        held = b[["id", "tag", "begin"]].iloc[order].to_dict("records")
        cut = [0, *(np.flatnonzero(context[1:] != context[:-1]) + 1).tolist(), len(b)]
        lists = [(context[i], held[i:j]) for lo, hi in zip(cut, cut[1:]) for i in range(lo, hi, PACKED) for j in (min(i + PACKED, hi),)]
        yield pd.DataFrame(lists, columns=["context", "held"])


def _hot_spans(rows: DataFrame, units: Units, window: int, earlier: bool, id_type: str) -> DataFrame:
    """(id, tag, spans) of the rows of hot classes, by way of their contexts."""
    sizes = F.encode(F.concat_ws(",", F.octet_length("left"), "most", "least"), "utf-8")
    rows = common.staged(rows.withColumn("context", F.unhex(F.md5(F.concat(sizes, "class", "left", "right")))), "hot")
    low, high = (F.min("id"), F.max("id")) if earlier else (F.lit(0).cast("long"), F.lit(0).cast("long"))
    contexts = rows.groupBy("context").agg(*[F.any_value(c).alias(c) for c in ("class", "length", "most", "least", "left", "right")], F.count(F.lit(1)).alias("n"), low.alias("low"), high.alias("high"))
    contexts = common.staged(contexts, "contexts")
    many = common.staged(contexts.groupBy("class").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT).select("class"), "hot-classes")
    low_type = id_type if earlier else "bigint"
    found_type = f"context binary, most int, least int, low {low_type}"
    few = contexts.join(many, "class", "left_anti").repartition(common.partitions(rows), "class").sortWithinPartitions("class")
    found = few.mapInPandas(_judge_contexts(units, window, earlier), found_type)
    if not many.isEmpty():
        each = common.staged(contexts.join(many, "class", "left_semi").mapInPandas(_named_windows(units, window), f"a long, c long, context binary, offset int, n long, low {low_type}, high {low_type}"), "windows")
        known = each.groupBy("a", "c").agg(F.sum("n").alias("total"), F.min("low").alias("first")).where("total > 1")
        hit = each.join(known, ["a", "c"]).where("first < high" if earlier else "total > 1").select("context", "offset", F.col("first").alias("low"))
        # neighbouring offsets with one first id are one run
        island = F.col("offset") - F.row_number().over(Window.partitionBy("context", "low").orderBy("offset"))
        hit = hit.withColumn("island", island).groupBy("context", "low", "island").agg(F.max("offset").alias("most"), F.min("offset").alias("least"))
        found = found.unionByName(hit.select("context", "most", "least", "low"))
    # a context has no more runs than a window has offsets, so they travel to its rows as one list
    found = common.staged(found.groupBy("context").agg(F.collect_list(F.struct("most", "least", "low")).alias("runs")), "found")
    # so do its rows, in lists of PACKED at most that a task makes: a passage in all documents costs a row for each task
    packed = rows.select("context", "id", "tag", "begin").mapInPandas(_pack, f"context binary, held array<struct<id:{id_type},tag:bigint,begin:int>>")
    own = packed.join(found, "context").repartition(common.partitions(rows)).select("runs", F.explode("held").alias("row")).select("row.*", "runs")
    mine = F.filter("runs", lambda r: F.col("id") > r["low"]) if earlier else F.col("runs")
    spans = F.transform(mine, lambda r: F.struct((F.col("begin") - r["most"]).cast("int").alias("from"), (F.col("begin") - r["least"] + window).cast("int").alias("to")))
    return own.select("id", "tag", spans.alias("spans"))


def repeated_spans(docs: DataFrame, units: Units, window: int, earlier: bool) -> DataFrame:
    """(id, tag, text, copies, spans): every row of ``docs`` (id, tag, text, copies) with the spans that repeated windows cover.

    ``earlier``: a window counts as repeated where its content also occurs under a smaller id (rows without an id
    neither repeat nor are repeated); otherwise wherever it occurs at another place, in the same text or another.
    Spans may overlap and count units. (id, tag) names the rows with one text under one id.
    """
    id_type = docs.schema["id"].dataType.simpleString()
    judged = docs.where("id is not null") if earlier else docs
    rows = common.staged(judged.mapInPandas(_emit(units, window), f"core long, id {id_type}, tag long, begin int, length int, most int, least int"), "anchors")
    met = rows.groupBy("core").agg(F.count(F.lit(1)).alias("n"), *([F.min("id").alias("low"), F.max("id").alias("high")] if earlier else []))
    met = common.staged(met.where("low < high" if earlier else "n > 1").select("core", "n"), "cores")

    def sides(cores: DataFrame) -> DataFrame:
        own = rows.join(cores, "core").groupBy("id", "tag").agg(F.collect_list(F.struct("begin", "length", "most", "least")).alias("rows"))
        found = docs.join(own, _same(docs, own)).select(docs["id"], docs["tag"], docs["text"], own["rows"])
        return found.mapInPandas(_sides(units, window), f"class binary, id {id_type}, tag long, begin int, length int, most int, least int, left binary, right binary")

    spans_type = f"id {id_type}, tag long, `from` int, `to` int"
    few = sides(met.where(F.col("n") <= HOT).select("core"))
    spans = few.repartition(common.partitions(docs), "class").sortWithinPartitions("class").mapInPandas(_judge(units, window, earlier), spans_type)
    spans = spans.groupBy("id", "tag").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    hot = met.where(F.col("n") > HOT)
    if not hot.isEmpty():
        spans = spans.unionByName(_hot_spans(sides(hot.select("core")), units, window, earlier, id_type))
        spans = spans.groupBy("id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return docs.join(spans, _same(docs, spans), "left").select(docs["id"], docs["tag"], docs["text"], docs["copies"], spans["spans"])


def _same(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["tag"] == b["tag"])


def tagged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """((id, tag, text, copies), whether ids are unique): the tag tells texts apart where ids aren't unique, and is 0 where they are; rows that repeat an id and text are one, with their number."""
    slim = common.plain(docs, id=id_col, text=text_col)
    if slim.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return slim.select("id", F.lit(0).cast("long").alias("tag"), "text", F.lit(1).cast("long").alias("copies")), True
    once = slim.withColumn("text", F.coalesce("text", F.lit(""))).groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))
    return common.staged(once.select("id", F.xxhash64("text").alias("tag"), "text", "copies"), "texts"), False


def to_rows(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, unique: bool) -> DataFrame:
    """``found`` (id, tag, ...) with one row for each of ``docs`` again."""
    if unique:
        return found.drop("tag")
    rows = docs.select(F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("own_tag"))
    return rows.join(found, rows["own_id"].eqNullSafe(found["id"]) & (rows["own_tag"] == found["tag"])).drop("own_id", "own_tag", "tag")


def merged(spans) -> list[tuple[int, int]]:
    """The union of spans, as disjoint spans that don't touch, in order."""
    if spans is None or not len(spans):
        return []
    out: list[list[int]] = []
    for begin, end in sorted((s["from"], s["to"]) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]
