"""Filters that decide which rows a step takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped


def _limited(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def valid_triples(df: DataFrame) -> DataFrame:
    """Rows whose three parts are not blank, trimmed; a missing confidence is 0.5, one that is no number drops the row."""
    parts = df.withColumns({c: stripped(F.col(c)) for c in ("subject", "predicate", "object")})
    raw = F.col("confidence").cast("string")
    value = F.when(raw.isNull(), F.lit(0.5)).otherwise(F.expr("try_cast(confidence AS DOUBLE)"))
    return parts.withColumn("confidence", value).where((F.col("subject") != "") & (F.col("predicate") != "") & (F.col("object") != "") & F.col("confidence").isNotNull())


def needs_scrape(articles: DataFrame, queue: DataFrame, limit: int | None = 50) -> DataFrame:
    rows = articles.join(queue.where("status = 'PENDING'").select(F.col("article_id").alias("id")), "id").where("raw_text IS NULL OR length(raw_text) < 100")
    return _limited(rows.select("id", "url"), [F.col("id")], limit)


def needs_digest(articles: DataFrame, limit: int | None = 10) -> DataFrame:
    return _limited(articles.where("processed_at IS NULL AND url IS NOT NULL").select("id", "url"), [F.col("id")], limit)


def needs_provenance(facts: DataFrame, limit: int | None = 50) -> DataFrame:
    return _limited(facts.where("checked_at IS NULL AND embedding IS NOT NULL").select("id", "article_id"), [F.col("id")], limit)


def needs_topic(articles: DataFrame, queue: DataFrame, article_topics: DataFrame, limit: int | None = 500) -> DataFrame:
    rows = articles.join(queue.where("status = 'SCRAPED'").select(F.col("article_id").alias("id")), "id")
    rows = rows.join(article_topics.select(F.col("article_id").alias("id")), "id", "left_anti").where("title IS NOT NULL AND title <> '' AND raw_text IS NOT NULL AND raw_text <> ''")
    return _limited(rows.select("id", "title"), [F.col("id")], limit)


def _since(now: str, days: int) -> Column:
    return F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")


def baseline_facts(facts: DataFrame, articles: DataFrame, now: str, min_trust: float = 0.8, days: int = 7, limit: int | None = 500) -> DataFrame:
    """Original facts of trusted articles, older than ``days``, the newest first."""
    trusted = articles.where(F.col("trust_score") >= min_trust).select(F.col("id").alias("article_id"), "trust_score")
    rows = facts.where((F.col("created_at") < _since(now, days)) & F.col("is_original")).join(trusted, "article_id")
    return _limited(rows.select("id", "subject", "predicate", "object", "created_at", "trust_score", *(["embedding"] if "embedding" in facts.columns else [])), [F.desc("created_at"), F.col("id")], limit)


def facts_to_check(facts: DataFrame, articles: DataFrame, now: str, backfill: bool = False, days_back: int | None = None, limit: int | None = None) -> DataFrame:
    """Original facts: all of them, of the last ``days_back`` days, or of the last day."""
    rows = facts.where("is_original").join(articles.select(F.col("id").alias("article_id")), "article_id")
    if not backfill or days_back is not None:
        rows = rows.where(F.col("created_at") >= _since(now, days_back or 1))
    return _limited(rows.select("id", "subject", "predicate", "object", "created_at", *(["embedding"] if "embedding" in facts.columns else [])), [F.desc("created_at"), F.col("id")], limit)


def gate_facts(facts: DataFrame) -> DataFrame:
    return facts.where("is_original AND checked_at IS NOT NULL")


def gate_assertions(facts: DataFrame, articles: DataFrame) -> DataFrame:
    rows = facts.where("article_id IS NOT NULL AND (is_original OR provenance_id IS NOT NULL)").select(F.col("id").alias("fact_id"), "article_id", "is_original", "provenance_id")
    return rows.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi").select("fact_id", "article_id", "is_original", "provenance_id")


def gate_articles(articles: DataFrame, article_topics: DataFrame) -> DataFrame:
    topical = article_topics.select(F.col("article_id").alias("id")).distinct().withColumn("__topic", F.lit(True))
    return articles.join(topical, "id", "left").where("(processed_at IS NOT NULL AND __topic) OR is_reference").drop("__topic").distinct()


def facts_by_subject(facts: DataFrame, subject: str, limit: int = 20) -> DataFrame:
    return facts.where(F.lower("subject") == subject.lower()).select("id", "subject", "confidence").orderBy(F.desc("confidence"), "id").limit(limit)


def invalid_confidence(facts: DataFrame) -> DataFrame:
    return facts.where("confidence < 0 OR confidence > 1")


def missing_text(vertices: DataFrame) -> DataFrame:
    return vertices.where("text IS NULL OR text = ''")
