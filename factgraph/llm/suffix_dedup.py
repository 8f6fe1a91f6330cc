"""Substring deduplication over bytes by anchors of a rolling hash.

A hash rolls over every text, and each window of 400 bytes takes the position of its least hash as its anchor: equal
windows take the same one, and neighbouring windows mostly share theirs. Windows whose bytes around the anchor are equal
form a class, and within a class they are told apart by what lies to the left and to the right; see ``repeats``.

Prefix-free parsing goes on from such triggers to a dictionary of phrases, a parse and their suffix arrays. That part
is not here: README says why.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common, repeats, textkit

#: Bytes under the rolling hash.
ROLLING = 32


def sites(texts: list[bytes], window: int) -> repeats.Sites:
    buffer, starts = textkit.joined(texts)
    symbols = textkit.BYTE_VALUE[buffer]
    rolling = min(ROLLING, 1 << (window.bit_length() - 1))
    begin = repeats.window_starts(starts[:-1], np.diff(starts) - 1, window)
    if not len(begin):
        none = np.zeros(0, dtype=np.int64)
        return repeats.Sites(symbols, starts, none, none, none)
    level, size, span = repeats.pack(textkit.doubles(symbols, rolling)), 1, window - rolling + 1
    while 2 * size <= span:
        level, size = np.minimum(level[:-size], level[size:]), 2 * size
    at = repeats.place(np.minimum(level[begin], level[begin + span - size]))
    i, j = repeats.runs((at[1:] == at[:-1]) & (begin[1:] == begin[:-1] + 1))
    return repeats.Sites(symbols, starts, at[i], begin[i], begin[j])


def _cut(text: bytes):
    return lambda begin, end: text[begin:end]


def _symbols(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return textkit.BYTE_VALUE[np.frombuffer(b"".join(parts), dtype=np.uint8)], starts


BYTES = repeats.Units(len, sites, _cut, _symbols)


def remove_repeats(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, spans): each text's UTF-8 bytes without those that repeated strings cover.

    A byte goes if any string of ``window`` bytes that covers it also starts anywhere else, in the same text or in
    another; strings never cross texts, overlaps count, and strings are judged on the input. ``spans`` are the
    maximal removed byte ranges [from, to).

    Nulls: a null text is empty; rows without an id take part like any other. Rows that repeat are texts of their
    own, so both lose what they share. Texts shorter than the window keep all. An empty table gives an empty
    result; extra columns are not read.
    """
    common.short_batches(docs.sparkSession)
    texts, unique = repeats.tagged(docs, id_col, text_col)
    found = repeats.repeated_spans(texts, BYTES, window, earlier=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, tag, text, copies, spans in zip(b["id"], b["tag"], b["text"], b["copies"], b["spans"]):
                data = (text or "").encode("utf-8", "replace")
                gone = [(0, len(data))] if copies > 1 and len(data) >= window else repeats.merged(spans)
                at, kept = 0, []
                for i, j in gone:
                    kept.append(data[at:i])
                    at = j
                kept.append(data[at:])
                out.append((id_, tag, len(data), sum(j - i for i, j in gone), len(gone), b"".join(kept), [{"from": i, "to": j} for i, j in gone]))
            yield pd.DataFrame(out, columns=["id", "tag", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    id_type = found.schema["id"].dataType.simpleString()
    judged = found.mapInPandas(run, f"id {id_type}, tag long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<`from`:int,`to`:int>>")
    return repeats.to_rows(judged, docs, id_col, text_col, unique).withColumnRenamed("id", "doc_id")
