"""Consistency of the published graph with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged

#: Edge types that are expected to leave a fact.
EXPECTED = ["MENTIONS", "SUPPORTS", "CONTRADICTS", "CITES", "VERIFIES", "SIMILAR_TO"]


#: Buckets whose digests are compared.
BUCKETS = 65_536


def _bucket() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")


def _digests(ids: DataFrame) -> DataFrame:
    """(bucket, n, a, b): the number of ids and two sums of their hashes, in whatever order they come; sums before the shuffle."""
    wide = lambda seed: F.sum(F.xxhash64("id", F.lit(seed)).cast("decimal(38,0)"))
    return ids.groupBy(_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"), wide(1).alias("a"), wide(2).alias("b"))


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """(bucket) of the buckets of ids (id) whose digests differ between the sides; BUCKETS rows at most."""
    x, y = _digests(one), _digests(other).withColumnsRenamed({"n": "n2", "a": "a2", "b": "b2"})
    same = F.col("n").eqNullSafe(F.col("n2")) & F.col("a").eqNullSafe(F.col("a2")) & F.col("b").eqNullSafe(F.col("b2"))
    return x.join(y, "bucket", "full_outer").where(~same).select("bucket")


def consistency_diff(graph_ids: DataFrame, table_ids: DataFrame) -> DataFrame:
    """(id, type, severity) of ids on one side only, compared as text.

    Both sides are summed up bucket by bucket first, and only ids in buckets that differ are compared: two large tables
    that agree but for a few ids shuffle a few buckets. Ids that repeat on one side make a bucket differ, no more.
    """
    g, t = graph_ids.select(F.col("id").cast("string")), table_ids.select(F.col("id").cast("string"))
    odd = staged(differing(g, t), "buckets")
    left = lambda df: df.withColumn("bucket", _bucket()).join(F.broadcast(odd), "bucket", "left_semi").select("id").distinct()  # noqa: E731  BUCKETS rows at most
    g, t = left(g), left(t)
    issue = lambda df, kind, severity: df.select("id", F.lit(kind).alias("type"), F.lit(severity).alias("severity"))
    return issue(g.join(t, "id", "left_anti"), "ORPHANED", "HIGH").unionByName(issue(t.join(g, "id", "left_anti"), "MISSING", "MEDIUM"))


def unexpected_types(edges: DataFrame) -> DataFrame:
    kinds = edges.where("type <> 'ASSERTED'").select("type").distinct()
    return kinds.where(~F.col("type").isin(EXPECTED)).select(F.col("type").alias("id"), F.lit("UNEXPECTED_RELATIONSHIP_TYPE").alias("type"), F.lit("MEDIUM").alias("severity"))


def integrity(vertices: DataFrame) -> DataFrame:
    f = vertices.where("label = 'Fact'")
    bad = f.where("confidence < 0 OR confidence > 1").select(F.col("id").cast("string"), F.lit("INVALID_CONFIDENCE").alias("type"), F.lit("HIGH").alias("severity"))
    empty = f.where("text IS NULL OR text = ''").select(F.col("id").cast("string"), F.lit("MISSING_TEXT").alias("type"), F.lit("HIGH").alias("severity"))
    return bad.unionByName(empty)


def consistency_report(vertices: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """All issues of all checks."""
    graph = vertices.where("label = 'Fact'").select("id")
    return consistency_diff(graph, facts.select("id")).unionByName(unexpected_types(edges)).unionByName(integrity(vertices))


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"))
