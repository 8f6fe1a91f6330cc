"""Where facts come from: the earliest similar fact, or an external source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import knn_neighbors, staged
from .tables import insert_ignore


def earliest_source(neighbors: DataFrame, dated: DataFrame) -> DataFrame:
    """(id, source_id): of each fact's neighbours the one with the earliest date, if it is before the fact's own; ties go to the nearest."""
    own = neighbors.join(dated.select("id", F.col("date").alias("own_date")), "id")
    other = dated.select(F.col("id").alias("neighbor_id"), "date")
    early = own.join(other, "neighbor_id").where("date < own_date")
    return early.groupBy("id").agg(F.min(F.struct("date", "distance", "neighbor_id")).alias("m")).select("id", F.col("m.neighbor_id").alias("source_id"))


def trace_provenance(facts: DataFrame, articles: DataFrame, external: DataFrame | None = None, threshold: float = 0.15, k: int = 10, resolve_root: bool = False) -> DataFrame:
    """(id, is_original, provenance_id, external_source_url, original_source_id, checked) of each fact.

    A fact without a date stays unchecked. ``external`` (fact_id, rank, url, title, date) holds outside hits: a fact
    that is original among the facts but has a first-ranked hit is not original, and its source is that url's article.
    ``resolve_root`` follows echoes of echoes to their origin by pointer jumping.
    """
    dated = facts.join(articles.select(F.col("id").alias("article_id"), F.col("published_date").alias("date")), "article_id", "left").select("id", "date")
    source = staged(earliest_source(knn_neighbors(facts, threshold, k), dated), "sources")
    if resolve_root:
        while True:
            up = source.join(source.select(F.col("id").alias("source_id"), F.col("source_id").alias("root")), "source_id", "left").select("id", F.coalesce("root", "source_id").alias("new"), (F.col("root").isNotNull()).alias("moved"))
            up = staged(up, "roots")
            source = up.select("id", F.col("new").alias("source_id"))
            if up.where("moved").isEmpty():
                break
    out = dated.join(source, "id", "left")
    if external is not None:
        first = external.where("rank = 1").groupBy(F.col("fact_id").alias("id")).agg(F.min("url").alias("url"))
        ids = articles.select(F.col("url"), F.col("id").alias("reference_id"))
        out = out.join(first.join(ids, "url", "left"), "id", "left")
    else:
        out = out.withColumns({"url": F.lit(None).cast("string"), "reference_id": F.lit(None).cast("long")})
    checked = F.col("date").isNotNull()
    outside = checked & F.col("source_id").isNull() & F.col("url").isNotNull()
    return out.select(
        "id", F.when(checked, F.col("source_id").isNull() & ~outside).alias("is_original"), F.when(checked, F.col("source_id")).alias("provenance_id"),
        F.when(outside, F.col("url")).alias("external_source_url"), F.when(outside, F.col("reference_id")).alias("original_source_id"), checked.alias("checked"))


def external_reference(articles: DataFrame, external: DataFrame) -> DataFrame:
    """Articles and a reference article for every first-ranked external url that is not among them; new ids follow the largest."""
    hits = external.where("rank = 1").groupBy("url").agg(F.min(F.struct("fact_id", "title", "date")).alias("h"))
    top = articles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    new = hits.crossJoin(F.broadcast(top)).select((F.col("top") + 1 + F.col("h.fact_id")).alias("id"), "url", F.col("h.title").alias("title"), F.col("h.date").alias("published_date"), F.lit(True).alias("is_reference"))
    return insert_ignore(articles.select("id", "url", "title", "published_date", "is_reference"), new, ["url"], [F.col("id")])


def provenance_lookup(ids: DataFrame, facts: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, statement, url, master_id, master_statement, master_url): each fact with the one that it echoes."""
    f = facts.join(articles.select(F.col("id").alias("article_id"), "url"), "article_id", "left").select("id", F.concat_ws(" ", "subject", "predicate", "object").alias("statement"), "url", "provenance_id")
    master = f.select(F.col("id").alias("provenance_id"), F.col("id").alias("master_id"), F.col("statement").alias("master_statement"), F.col("url").alias("master_url"))
    return f.join(ids.select("id").distinct(), "id", "left_semi").join(master, "provenance_id", "left").select("id", "statement", "url", "master_id", "master_statement", "master_url")


def latest_facts(facts: DataFrame, articles: DataFrame, limit: int = 50) -> DataFrame:
    a = articles.select(F.col("id").alias("article_id"), "title", "url")
    return facts.join(a, "article_id").select("id", "subject", "predicate", "object", "confidence", "created_at", "title", "url").orderBy(F.desc("created_at"), "id").limit(limit)
