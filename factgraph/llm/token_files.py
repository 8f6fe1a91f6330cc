"""Token-id files: ids ranked by frequency, in byte-aligned codes whose control bytes lie apart from the data bytes.

The files are Parquet tables of blocks, so any store that Spark writes to holds them, and the commit
protocol guards them against lost executors. A block holds consecutive documents in ascending id order:

* ``ranks``: the block's distinct ids, the most frequent first, as unsigned 32-bit integers; a token is coded as its place here;
* ``control``: two bits a token, four tokens to a byte, the first in the low bits: its code's length less one;
* ``data``: the codes, one to four little-endian bytes each;
* ``doc_ids`` and ``lengths``: each document's id and number of tokens.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Tokens in a block, apart from a longer document, which is a block of its own.
BLOCK_TOKENS = 1 << 20
#: Pieces that a worker remembers, and bytes of them and their ids, before those not met again go, and characters of a piece that is worth it; only speed depends on these.
REMEMBERED, REMEMBERED_BYTES, PIECE = 600_000, 64 << 20, 64
#: Texts that show whether a file cuts and lower-cases as the pieces here rely on.
PROBES = ("Hello, World! (x)  y\tz\nÀÉ'n.", "don't STOP-now... a_b", "  leads and trails  ", "ÿÖ12 x9, 漢字 🙂", "a\u00a0b\u2003c \x01 d", "UPPER lower Ünï, über-all; naïve.", "")
#: A control character: between spaces it is a piece of its own, whose id no piece without it has.
PARTING = "\x01"
#: For each control byte, the lengths of its four codes.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)
BLOCKS = "shard int, block int, n_docs int, n_tokens long, doc_ids binary, lengths binary, ranks binary, control binary, data binary"
ROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), *[(c, pa.binary()) for c in ("doc_ids", "lengths", "ranks", "control", "data")]])


class Encoder:
    """The library's ids of texts. Where a file drops white space and no merge crosses it, pieces between spaces, tabs and newlines are encoded once and remembered; texts of other files are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        alone = self.library.encode(PARTING, add_special_tokens=False).ids
        self.parting = alone[0] if len(alone) == 1 else None
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.in_pieces = True
        ids, n = self.ids(pa.array(PROBES), None)
        self.in_pieces = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in self.library.encode_batch_fast(list(PROBES), add_special_tokens=False)]

    def ids(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); null counts as empty.

        Arrow splits the texts and gives every distinct piece of the batch a code, so Python sees a piece once a batch;
        ids are then gathered by code.
        """
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        plain = pc.cast(pc.fill_null(texts, ""), pa.large_string())
        if not self.in_pieces:
            each = [np.array(self.library.encode(t, add_special_tokens=False).ids + ([] if end is None else [end]), dtype=np.uint32) for t in plain.to_pylist()]
            return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
        parts = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, "\t", " "), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        table = self.lookup(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        start = np.cumsum(size) - size
        code = coded.indices.to_numpy(zero_copy_only=False)
        offset = parts.offsets.to_numpy()
        each = size[code]
        upto = np.concatenate(([0], np.cumsum(each)))
        n = upto[offset[1:] - offset[0]] - upto[offset[:-1] - offset[0]]
        at = np.repeat(start[code] - upto[:-1], each) + np.arange(upto[-1])
        ids = np.frombuffer(b"".join(table), dtype="<u4")[at]
        if end is None:
            return ids, n
        out = np.full(len(ids) + len(n), end, dtype=np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
        return out, n + 1

    def lookup(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known, self.old, self.held = {}, self.known, 0
        known, old = self.known, self.old
        known.update((p, old[p]) for p in pieces if p not in known and p in old)
        long = {p: self.encoded(p) for p in pieces if len(p) > PIECE}
        parted = {p: _parted(p) for p in pieces if p not in known and p not in long}
        words = list({parts[0] for parts in parted.values() if parts and parts[0] not in known})
        other = list({x for p, parts in parted.items() for x in (parts[1:] if parts else (p,)) if x not in known})
        for at in range(0, len(words), 20_000):
            self.learn_words(words[at : at + 20_000])
        for at in range(0, len(other), 20_000):
            self.learn(other[at : at + 20_000])
        for p, parts in parted.items():
            if parts:
                known[p] = known[parts[0]] + known[parts[1]]
        self.held += sum(len(p) + len(known[p]) for p in parted)
        return [long[p] if p in long else known[p] for p in pieces]

    def encoded(self, piece: str) -> bytes:
        """The ids of one piece, not remembered."""
        return np.array(self.library.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn_words(self, words: list[str]) -> None:
        """Encode words of letters in one call: each gives at least one piece, so where as many pieces end as there are words, each word is one."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        end = np.flatnonzero(self.ends[ids]) + 1
        if len(end) == len(words) and end[-1] == len(ids):
            self.remember(words, ids, np.concatenate(([0], end[:-1])), end)
        else:
            self.learn(words)

    def learn(self, pieces: list[str]) -> None:
        """Encode many pieces in one call, with a piece between them that has one id and is found in no other way."""
        odd = [p for p in pieces if PARTING in p] if self.parting is not None else pieces
        for piece, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False) if odd else []):
            self.known[piece] = np.array(e.ids, dtype="<u4").tobytes()
        pieces = [p for p in pieces if p not in self.known]
        if pieces:
            ids = np.array(self.library.encode_batch_fast([f" {PARTING} ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(ids == self.parting)
            self.remember(pieces, ids, np.concatenate(([0], cut + 1)), np.append(cut, len(ids)))

    def remember(self, pieces: list[str], ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        raw = ids.tobytes()
        self.known.update((p, raw[i:j]) for p, i, j in zip(pieces, (4 * begin).tolist(), (4 * end).tolist()))


def _parted(piece: str) -> tuple[str, str] | None:
    """A piece of letters up to U+00FF and then only ASCII marks, as (letters in lower case, marks): the file cuts it there and lower-cases it itself. None for others."""
    word = piece.rstrip(string.punctuation)
    return (word.lower(), piece[len(word) :]) if word.isalpha() and max(word) <= "\xff" else None


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranks, control, data) of the ids."""
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    ranks = distinct[np.argsort(-counts[distinct], kind="stable")]  # equally frequent ids stay in ascending order
    rank = np.empty(len(counts), dtype=np.uint32)
    rank[ranks] = np.arange(len(ranks), dtype=np.uint32)
    codes = rank[ids]
    size = 1 + (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    two = np.zeros(-(-len(codes) // 4) * 4, dtype=np.uint8)
    two[: len(codes)] = size - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    used = np.arange(4) < size[:, None]
    return ranks.astype("<u4").tobytes(), control.tobytes(), codes.astype("<u4").view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids that ``pack`` packed: code lengths come from a table of control bytes, ids from the table of ranks."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n].astype(np.int64)
    begin = np.cumsum(size) - size
    raw = np.concatenate((np.frombuffer(data, dtype=np.uint8), np.zeros(4, np.uint8)))
    codes = raw[begin].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        codes[longer] |= raw[begin[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranks, dtype="<u4")[codes]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the ids to ``path`` in ascending order of the id column.

    One shuffle, by ranges of the id; each task sorts and codes its range block by block. Null texts count as
    empty; a null id sorts first; rows that repeat an id are documents of their own, in any order among
    themselves; an empty table gives no blocks; extra columns are not read. Ids are long integers.
    """
    spark = docs.sparkSession
    common.short_batches(spark)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ranged = slim.repartitionByRange(common.partitions(docs), "id").sortWithinPartitions("id").withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = load(tokenizer), 0
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        total, shard = 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            ranks, control, data = pack(ids)
            null = [k is None for k in keys]
            doc_ids = np.array([k or 0 for k in keys], dtype="<i8").tobytes() + np.packbits(null).tobytes() * any(null)
            row = {"shard": shard, "block": block, "n_docs": len(keys), "n_tokens": len(ids), "doc_ids": doc_ids, "lengths": np.array([len(x) for x in held], dtype="<i8").tobytes(), "ranks": ranks, "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], ROW)

        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column("shard")[0].as_py()
            ids, sizes = encoder.ids(b.column("text"), end_id)
            for key, own in zip(b.column("id").to_pylist(), np.split(ids, np.cumsum(sizes)[:-1])):
                if held and total + len(own) > BLOCK_TOKENS:
                    yield flush()
                    held, keys, total, block = [], [], 0, block + 1
                held.append(own)
                keys.append(key)
                total += len(own)
        if held:
            yield flush()

    ranged.mapInArrow(run, BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids binary) of every document in the files; ``start`` counts the ids of all documents before it.

    A block's place follows from the token counts of the blocks before it: sums by shard, then a running sum
    over the shards (one row each) and over a shard's blocks. ``with_ids=False`` leaves the ids out, before
    the join with the places.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    counts = blocks.select("shard", "block", "n_tokens")
    shards = counts.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.withColumn("within", within).join(shards.select("shard", "base"), "shard").select("shard", "block", (F.col("base") + F.col("within")).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids = unpack(r.ranks, r.control, r.data, r.n_tokens)
                n = np.frombuffer(r.lengths, dtype="<i8")
                to = np.cumsum(n)
                keys = pd.array(np.frombuffer(r.doc_ids[: 8 * r.n_docs], dtype="<i8"), dtype="Int64")
                if len(r.doc_ids) > 8 * r.n_docs:
                    keys[np.unpackbits(np.frombuffer(r.doc_ids[8 * r.n_docs :], dtype=np.uint8))[: r.n_docs].astype(bool)] = pd.NA
                own = [ids[s:e].tobytes() for s, e in zip(to - n, to)]
                out = {"shard": r.shard, "block": r.block, "doc_id": keys, "rel": to - n, "n_tokens": n, "ids_crc32": [zlib.crc32(x) for x in own]}
                yield pd.DataFrame(out | {"ids": own} if with_ids else out)

    decoded = blocks.mapInPandas(run, "shard int, block int, doc_id long, rel long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return decoded.join(places, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
