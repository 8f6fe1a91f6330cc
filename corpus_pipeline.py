"""From raw documents to token ids: quality, exact copies, near copies, benchmark leaks, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import bpe, common, decontaminate, exact_dedup, near_dedup, quality
from factgraph.llm.queries import table, vocabulary

#: Dropped ids are broadcast up to this number (about 100 MB); beyond it the join shuffles.
BROADCAST_DROPPED = 1_000_000


def _without(docs: DataFrame, judged: DataFrame, digest: F.Column) -> DataFrame:
    """The rows of ``docs``, whatever other columns they have, but those that ``judged`` (doc_id, kept, digest) doesn't keep; a null id is an id like any other."""
    gone = common.staged(judged.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct(), "dropped")
    return docs.join(common.if_small(gone, BROADCAST_DROPPED), docs["doc_id"].eqNullSafe(gone["__id"]) & (digest == gone["__digest"]), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of documents outside the held-out fold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id"), 4, 2)))
    return quality.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return _without(docs, exact_dedup.exact_dedup(docs), F.sha2(exact_dedup.normalised(F.col("text")), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id."""
    return _without(docs, near_dedup.near_duplicates(docs), F.md5(F.coalesce("text", F.lit(""))))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text that they decode to."""
    return bpe.digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("bpe", encode)]

#: The classifier cannot be put in SQL; tests hold the pipeline against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the staged result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
