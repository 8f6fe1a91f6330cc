"""Exact deduplication as a stateful stream over disk-backed keyed state.

The state keeps for each digest a stable identifier, the locator of the first content that had it and the number of rows.
A call writes its digests into an inbox once, under its own name, and then lets the stream run over what is new there: a
call that failed anywhere and is made again finds its inbox, and the stream goes on where it stopped, so that no row
counts twice. Only what the stream writes since a call began is read for it, however long the history.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import staging
from . import common

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the state store is set to while a stream runs: on disk, and without setting aside megabytes for each small file.
STORE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}

#: What names a text: its digest, and a second one of another kind with the text's length, which texts of earlier calls are told apart by.
KEY = ["digest", "other"]


def _other(norm: Column) -> Column:
    """A second digest of another kind, with the length."""
    return F.concat_ws(":", F.md5(norm), F.octet_length(norm))


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


AT = "struct<file:string,row:bigint>"


def _name(slim: DataFrame) -> str:
    """A name for a call by its rows, in whatever order they come."""
    r = slim.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", *KEY).cast("decimal(38,0)")), F.sum(F.xxhash64(*KEY, "id").cast("decimal(38,0)"))).first()
    return "_".join(str(x or 0) for x in r).replace("-", "m")


def _stream(slim: DataFrame, state_dir: str, call: str) -> tuple[DataFrame, DataFrame | None]:
    """Feed ``slim`` to the keyed state in ``state_dir``: (digest, other, keep_id, keep_at, first_at, group_size) of the pairs of digests that it has, and what earlier calls wrote, if there were any."""
    spark = slim.sparkSession
    inbox, groups, calls = f"{state_dir}/inbox", f"{state_dir}/groups", f"{state_dir}/calls/{call}"
    schema = f"digest string, other string, keep_id {slim.schema['id'].dataType.simpleString()}, keep_at {AT}, first_at {AT}, group_size long"
    first = next(iter(staging.numbered(spark, calls, "from")), None)
    if first is None:  # batches from here on may have rows of this call
        first = max(staging.numbered(spark, groups, "batch"), default=-1) + 1
        spark.createDataFrame([(first,)], "first int").write.mode("overwrite").parquet(f"{calls}/from={first}")
    if not staging.exists(spark, f"{inbox}/{call}/_SUCCESS"):
        slim.write.mode("overwrite").parquet(f"{inbox}/{call}")
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        state = (
            spark.readStream.schema(slim.schema).parquet(f"{inbox}/*")
            .groupBy(*KEY)  # no watermark: state never expires; partial sums before the shuffle take copies of one text apart from their number
            .agg(F.max("id").alias("keep_id"), F.max_by("at", "id").alias("keep_at"), F.min_by("at", F.struct("seq", "id")).alias("first_at"), F.count(F.lit(1)).alias("group_size"))
        )
        (
            state.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", f"{state_dir}/checkpoint")
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{groups}/batch={batch}"))
            .start().awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    read = lambda ns: spark.read.schema(schema).parquet(*[f"{groups}/batch={n}" for n in ns]) if ns else spark.createDataFrame([], schema)
    ran = staging.numbered(spark, groups, "batch")
    return _last(read([n for n in ran if n >= first])), read([n for n in ran if n < first]) if first else None


def _last(groups: DataFrame) -> DataFrame:
    """A digest is written anew by each batch that adds to it; counts only grow, so the largest is the last."""
    return groups.groupBy(*KEY).agg(F.max("keep_id").alias("keep_id"), F.max_by("keep_at", "group_size").alias("keep_at"), F.max_by("first_at", "group_size").alias("first_at"), F.max("group_size").alias("group_size"))


def _located(at: DataFrame, text_col: str) -> DataFrame:
    """(digest, other, norm): the texts at the locators (digest, other, file, row), read from their files again; those of files that are gone are left out."""
    spark = at.sparkSession
    files = [r["file"] for r in at.select("file").distinct().collect()]  # the names of input files
    names = [f for f in files if staging.exists(spark, f)]
    if not names:
        return spark.createDataFrame([], "digest string, other string, norm string")
    rows = spark.read.parquet(*names).select(normalised(F.col(f"`{text_col}`")).alias("norm"), F.expr("_metadata.file_path AS file"), F.expr("_metadata.row_index AS row"))
    return rows.join(at, ["file", "row"]).select(*KEY, "norm")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None, digest=lambda c: F.sha2(c, 256), call: str | None = None) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, digest, keep_at).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays. A stream with RocksDB state, keyed by digest and never expiring, keeps for each digest the
    id to keep, the locator of its content (file and row, where the input comes straight from files) and the
    number of rows. Digests that were hit more than once are then checked on the full bytes of their texts, and
    should one digest stand for different texts, these become groups of their own. The first text of a digest that
    earlier calls had is read where its locator points; where its file is gone, or had none, two digests of different kinds
    and the length tell the texts apart.

    ``state_dir``: a folder whose state is kept between calls, so that later calls dedup against earlier rows
    (results are for the rows of this call); None starts with empty state. ``call`` names a call, by default by its
    rows: a call of the same name is the same call, made again after a failure, and adds nothing twice; rows that really
    came a second time need a name of their own.

    Nulls: a null id is the smallest. Rows that repeat an id and text are one document: each counts in
    group_size, and they share ``kept``. An empty table gives an empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    common.short_batches(spark)
    at = "struct(_metadata.file_path as file, _metadata.row_index as row)"
    try:
        located = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm"), F.expr(at).alias("at"))
    except Exception as e:
        if "UNRESOLVED_COLUMN" not in str(e) and "FIELD_NOT_FOUND" not in str(e):
            raise
        located = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm"), F.lit(None).cast("struct<file:string,row:bigint>").alias("at"))
    located = located.withColumn("digest", digest(F.col("norm"))).withColumn("other", _other(F.col("norm")))
    slim = common.staged(located.select("id", *KEY, "at", F.current_timestamp().alias("seq")), "digests")
    fed, before = _stream(slim, state_dir or common.new_dir(spark, "dedup-state"), call or _name(slim))
    groups = common.staged(fed, "groups")

    # full bytes: the texts of one digest must be one text. Copies within a task collapse before the shuffle.
    hit = groups.where("group_size > 1").select(*KEY)
    texts = located.select(*KEY, "norm").join(hit, KEY, "left_semi").groupBy(*KEY, "norm").agg(F.lit(1).alias("one")).drop("one")
    earlier = None
    if before is not None:
        mine = slim.groupBy(*KEY).agg(F.count(F.lit(1)).alias("mine"))
        old = common.staged(groups.join(mine, KEY).where("group_size > mine AND first_at.file IS NOT NULL").select(*KEY, "first_at.file", "first_at.row"), "locators")
        earlier = common.staged(_located(old, text_col), "earlier texts")
        texts = texts.unionByName(earlier).distinct()
    clash = common.staged(texts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY), "clashes")
    result = slim.join(groups, KEY).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "keep_at", "other")
    if clash.isEmpty():
        return result.drop("other")
    odd = located.join(clash, KEY, "left_semi")
    parts = odd.select("id", "at", *KEY, "norm", F.lit(1).cast("long").alias("n"))
    if earlier is not None:  # what earlier calls had of these digests counts with the text that their locator shows
        known = _last(before.join(clash, KEY, "left_semi")).join(earlier, KEY)
        parts = parts.unionByName(known.select(F.col("keep_id").alias("id"), F.col("keep_at").alias("at"), *KEY, "norm", F.col("group_size").alias("n")))
    exact = parts.groupBy(*KEY, "norm").agg(F.max("id").alias("keep_id"), F.max_by("at", "id").alias("keep_at"), F.sum("n").alias("group_size"))
    parted = odd.select("id", *KEY, "norm").join(exact, [*KEY, "norm"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "keep_at")
    return result.join(clash, KEY, "left_anti").select(parted.columns).unionByName(parted)
