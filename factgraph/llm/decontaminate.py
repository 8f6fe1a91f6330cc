"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

An item's MinHash signature is its least shingle hashes, as many as an item of its size may miss and one more: for a
threshold of 0.8 a fifth of them and one. A document that holds enough of the item holds one of these at least, so the
search loses nothing, however short the item and long the document. Documents are partitioned by size: class c has
those of 2**c to 2**(c+1) - 1 shingles, and an item is searched for only in classes that can hold enough of it.
Documents that hold a signature hash are candidates; only their texts are read again, each cut into its shingles once
however many items it may hold, and items are verified by the exact containment of their shingles, as words and not as
hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
#: Signature hashes and candidates are broadcast only up to this number of rows (about 100 MB), items' shingles up to as many bytes; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 100_000_000


def words(text: Column) -> Column:
    """Lower-cased words between spaces and \\t-\\r."""
    return F.array_remove(F.split(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     "), " "), "")


def shingles(w: Column) -> Column:
    """Hashes of all runs of five words; a text of one to four words has one, of all its words; none without words."""
    last = F.greatest(F.size(w) - SHINGLE, F.lit(0))
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(w: Column) -> Column:
    """The distinct runs of five words as texts; words hold no space, so equal texts are equal runs."""
    last = F.greatest(F.size(w) - SHINGLE, F.lit(0))
    return F.when(F.size(w) > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " ")))).otherwise(F.array().cast("array<string>"))


def size_class(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")


def signatures(items: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item, size, shingles, signature, least_class) of each item; ``item`` tells texts of one id apart."""
    w = items.select(F.col(f"`{id_col}`").alias("item_id"), words(F.col(f"`{text_col}`")).alias("w"))
    s = w.select("item_id", shingle_texts(F.col("w")).alias("shingles"), F.sort_array(F.array_distinct(shingles(F.col("w")))).alias("hashes")).distinct()
    size, enough = F.size("shingles"), F.ceil(F.lit(threshold) * F.size("shingles")).cast("int")
    return s.select("item_id", F.md5(F.array_join("shingles", "\n")).alias("item"), size.alias("size"), "shingles", F.slice("hashes", F.lit(1), size - enough + 1).alias("signature"), size_class(enough).alias("least_class"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of every document and item with containment >= threshold.

    Containment is the share of the item's distinct shingles (five lower-cased words) that the document has. One
    pass over the documents; only shingles that an item's signature has leave the map side, and the texts of candidates
    are read once more.

    Nulls: null, empty and blank texts have no shingles and match nothing; a null id is kept as it is. Rows that
    repeat an id are documents (or items) of their own; of those that hold an item of one id, the largest containment
    stays. Texts of under five words have a single shingle. Empty tables give an empty result; extra columns are not
    read.
    """
    known = common.staged(signatures(items, threshold, item_id_col, item_text_col), "items").where("size > 0")
    probes = common.staged(known.select("item_id", "item", "least_class", F.explode("signature").alias("h")), "signatures")
    # a projection at a time, and no filter on what it makes (explode, unlike explode_outer, adds one): either would evaluate an expression once for each use
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"), words(F.col(f"`{text_col}`")).alias("w"))
    hashed = own.select("key", shingles(F.col("w")).alias("hashes"))
    sized = hashed.select("key", "hashes", size_class(F.size("hashes")).alias("c"))
    each = sized.select("key", "c", F.explode_outer("hashes").alias("h"))
    met = each.join(common.if_small(probes, BROADCAST_ROWS), "h").where("coalesce(c, 0) >= least_class")  # coalesce: of a bare column Spark would infer a filter below
    found = common.staged(met.select("key").distinct(), "candidates")

    # a candidate's key is a hash of its text: that another text may have it too costs a look at that text, no more
    texts = own.join(common.if_small(found, BROADCAST_ROWS), "key", "left_semi").select("doc_id", "key", F.explode(shingle_texts(F.col("w"))).alias("s"))
    parts = known.select("item_id", "item", F.col("size").cast("long").alias("n_shingles"), F.explode("shingles").alias("s"))
    few = (known.agg(F.sum(F.length(F.array_join("shingles", "")) + 64 * F.col("size"))).first()[0] or 0) <= BROADCAST_BYTES
    held = texts.join(F.broadcast(parts) if few else parts, "s")
    shared = held.select("doc_id", "key", "item_id", "item", "n_shingles", "s").distinct().groupBy("doc_id", "key", "item_id", "item", "n_shingles").agg(F.count(F.lit(1)).alias("n_shared"))
    best = shared.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shared", "n_shingles")).alias("b"))
    return best.where(F.col("b.n_shared") >= F.lit(threshold) * F.col("b.n_shingles")).select("doc_id", "item_id", "b.n_shared", "b.n_shingles", "b.containment")


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no item; rows with a null id stay only if none of them holds one. Without items all stay; an empty table stays empty."""
    hit = common.staged(contaminated(docs, items, threshold, id_col, text_col).select(F.col("doc_id").alias("__hit")).distinct(), "contaminated")
    return docs.join(common.if_small(hit, BROADCAST_ROWS), docs[id_col].eqNullSafe(hit["__hit"]), "left_anti")
