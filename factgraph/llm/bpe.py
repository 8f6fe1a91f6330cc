"""BPE encoding and decoding: byte-level merges over contiguous rank arrays."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from . import common

#: The split pattern of the byte-level tokenizer files, with the white space of Unicode spelled out.
_S = r"\t-\r \x85\xa0  -     　"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Words up to this many bytes are merged in the rank array, longer ones with a heap.
SHORT = 96
#: Words whose ids a worker remembers before it starts anew; only speed depends on it.
REMEMBERED = 300_000
NONE = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """The vocabulary of a byte-level BPE file, and its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_letters(), spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.byte_id = [0] * 256
        for letter, byte in letters.items():
            self.byte_id[byte] = vocab[letter]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.made.append(vocab[a + b])
        self.token = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = _Words(self)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank merges first, of equal ones the leftmost."""
        parts = [self.byte_id[b] for b in word]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank = self.rank.get
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [self.made[low]]  # a boundary goes
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in n log n steps, for words without a bound on their length."""
        n, rank = len(parts), self.rank.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a << 32 | b, NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.made[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (q := rank(parts[left] << 32 | parts[right], NONE)) != NONE:
                    heapq.heappush(heap, (q, left, parts[left], parts[right]))
        return [x for x in parts if x >= 0]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; strings of special tokens become their ids."""
        find, ids = SPLIT.findall, self.words.__getitem__
        if self.marks is None or not any(s in text for s in self.special):
            return b"".join(map(ids, find(text)))
        out = []
        for part in self.marks.split(text):
            out += [self.special[part].to_bytes(4, "little")] if part in self.special else map(ids, find(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


class _Words(dict):
    """Ids of words met before."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.bpe.merge(word.encode("utf-8", "replace")), dtype="<u4").tobytes()
        if len(word) <= SHORT:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): the token ids of each whole text as little-endian unsigned 32-bit integers.

    A narrow map: no shuffle, memory bounded by a batch and the remembered words. ``vocabulary`` is the file's
    path, which every worker opens. Null and empty texts give no ids; null ids and repeated rows pass through,
    one output row each; an empty table gives an empty one; extra columns are not read.
    """
    common.short_batches(docs.sparkSession)
    slim = common.plain(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [bpe.encode(t or "") for t in b["text"]]})

    return slim.mapInPandas(run, f"id {slim.schema['id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(id, text) of a table made by ``encode``; null ids decode to the empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": [bpe.decode(x or b"") for x in b["ids"]]})

    return encoded.mapInPandas(run, f"id {encoded.schema['id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ids and the text that they decode to, in one pass over the texts.

    Nulls, empty texts and repeated rows as in ``encode``.
    """
    common.short_batches(docs.sparkSession)
    slim = common.plain(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "ids": ids, "decoded": [bpe.decode(x) for x in ids]})

    return slim.mapInPandas(run, f"id {slim.schema['id'].dataType.simpleString()}, ids binary, decoded string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), made from the ids and decoded texts of ``round_trip``."""
    common.short_batches(docs.sparkSession)
    slim = common.plain(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
            })

    return slim.mapInPandas(run, f"doc_id {slim.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
