"""Substring deduplication over words by recompression.

The texts' words are named by their content. A round names maximal runs of one symbol, then splits the symbols by a
bit of their names into left and right ones and names each pair of a left and a right neighbour. Names are hashes
of what they stand for, so every task of the cluster gives the same run or pair the same name without a shuffled
name table. Each symbol carries its context: the words that had to be seen to know that it arises. Wherever these
words stand, the symbol stands too, so equal windows share every symbol whose context lies inside them. A window's
anchor is such a symbol of the highest round that has one, of these the one with the smallest name; see ``repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common, repeats, textkit
from .textkit import mix, name_pair

#: Rounds of run and pair naming. A symbol of round 2 covers 1.8 words of random text and has a context of a dozen.
ROUNDS = 2


@dataclass
class Level:
    """Symbols in text order: name, first word, text, and the words [seen_from, seen_to) that it depends on."""

    name: np.ndarray
    start: np.ndarray
    text: np.ndarray
    seen_from: np.ndarray
    seen_to: np.ndarray


def level_zero(names: np.ndarray, starts: np.ndarray) -> Level:
    at = np.arange(len(names))
    return Level(names, at, np.repeat(np.arange(len(starts) - 1), np.diff(starts)), at, at + 1)


def _neighbours(x: Level, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each symbol's left and right neighbour depends on; at a text's end, a place outside the text."""
    inner = x.text[1:] == x.text[:-1]
    before, after = starts[x.text] - 1, starts[x.text + 1] + 1
    before[1:][inner] = x.seen_from[:-1][inner]
    after[:-1][inner] = x.seen_to[1:][inner]
    return before, after


def name_runs(x: Level, starts: np.ndarray, salt: int) -> Level:
    """Maximal runs of one symbol become one symbol; what ends a run has to be seen, so contexts grow on both sides."""
    if not len(x.name):
        return x
    before, after = _neighbours(x, starts)
    i, j = repeats.runs((x.name[1:] == x.name[:-1]) & (x.text[1:] == x.text[:-1]))
    n = j - i + 1
    return Level(np.where(n > 1, name_pair(x.name[i], n.astype(np.uint64), salt), x.name[i]), x.start[i], x.text[i], before[i], after[j])


def name_pairs(x: Level, starts: np.ndarray, salt: int) -> Level:
    """Each left symbol and the right symbol after it become one; an unpaired symbol depends on the neighbour that could have joined it."""
    if not len(x.name):
        return x
    before, after = _neighbours(x, starts)
    is_right = (mix(x.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
    opens = np.zeros(len(x.name), dtype=bool)
    opens[:-1] = ~is_right[:-1] & is_right[1:] & (x.text[1:] == x.text[:-1])
    closes = np.concatenate(([False], opens[:-1]))
    alone = ~opens & ~closes
    name, seen_from, seen_to = x.name.copy(), x.seen_from.copy(), x.seen_to.copy()
    o = np.flatnonzero(opens)
    name[o] = name_pair(x.name[o], x.name[o + 1], salt)
    seen_to[o] = x.seen_to[o + 1]
    seen_to[alone & ~is_right] = after[alone & ~is_right]
    seen_from[alone & is_right] = before[alone & is_right]
    keep = ~closes
    return Level(name[keep], x.start[keep], x.text[keep], seen_from[keep], seen_to[keep])


def levels(names: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    out = [level_zero(names, starts)]
    for r in range(rounds):
        out.append(name_pairs(name_runs(out[-1], starts, 2 * r + 1), starts, 2 * r + 2))
    return out


def sites(texts: list[bytes], window: int) -> repeats.Sites:
    names, _, _, starts, _, _ = textkit.words(texts)
    begin = repeats.window_starts(starts[:-1], np.diff(starts), window)
    chosen, depth = np.zeros(len(begin), dtype=np.int64), np.full(len(begin), -1)
    grown = levels(names, starts)
    todo = np.arange(len(begin))
    for k in range(len(grown) - 1, -1, -1):
        x = grown[k]
        i, j = np.searchsorted(x.seen_from, begin[todo]), np.searchsorted(x.seen_to, begin[todo] + window, side="right")
        has = np.flatnonzero(j > i)
        if len(has):
            best = repeats.place(repeats.range_min(repeats.pack(x.name), i[has], j[has]))
            chosen[todo[has]], depth[todo[has]] = x.start[best], k
        todo = np.delete(todo, has)
    if not len(begin):
        none = np.zeros(0, dtype=np.int64)
        return repeats.Sites(names, starts, none, none, none)
    i, j = repeats.runs((chosen[1:] == chosen[:-1]) & (depth[1:] == depth[:-1]) & (begin[1:] == begin[:-1] + 1))
    return repeats.Sites(names, starts, chosen[i], begin[i], begin[j])


def _cut(text: bytes):
    words = text.split()
    return lambda begin, end: b" ".join(words[begin:end])


def _symbols(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    names, _, _, starts, _, _ = textkit.words(parts)
    return names, starts


WORDS = repeats.Units(lambda text: len(text.split()), sites, _cut, _symbols)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): each text without the words that repeat a document of smaller id.

    Words are runs of bytes other than space and \\t-\\r, unchanged. A word goes if any window of ``window`` words
    that covers it also starts in a document with a smaller id; windows are judged on the input. ``kept`` is the
    remaining words joined by one space, ``spans`` the removed word ranges [from, to).

    Nulls: a null text has no words; a row without an id is kept whole and removes nothing. Rows that repeat an id
    don't remove each other's words. Texts shorter than the window keep all. An empty table gives an empty result;
    extra columns are not read.
    """
    common.short_batches(docs.sparkSession)
    texts, unique = repeats.tagged(docs, id_col, text_col)
    found = repeats.repeated_spans(texts, WORDS, window, earlier=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, tag, text, spans in zip(b["id"], b["tag"], b["text"], b["spans"]):
                words = (text or "").encode("utf-8", "replace").split()
                gone = repeats.merged(spans)
                n, at, kept = len(words), 0, []
                for i, j in gone:
                    kept += words[at:i]
                    at = j
                kept += words[at:]
                out.append((id_, tag, n, n - len(kept), b" ".join(kept).decode(), [{"from": i, "to": j} for i, j in gone]))
            yield pd.DataFrame(out, columns=["id", "tag", "n_words", "n_removed", "kept", "spans"])

    id_type = found.schema["id"].dataType.simpleString()
    judged = found.mapInPandas(run, f"id {id_type}, tag long, n_words long, n_removed long, kept string, spans array<struct<`from`:int,`to`:int>>")
    return repeats.to_rows(judged, docs, id_col, text_col, unique).withColumnRenamed("id", "doc_id")
