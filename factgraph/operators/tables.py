"""Table mutation as pure functions: what a table is after an insert, upsert, transition or archive."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _null_key(keys: list[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with one key the first by ``order``; a null key conflicts with nothing, so all its rows stay."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    whole = df.where(~_null_key(keys)).withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return whole.unionByName(df.where(_null_key(keys)))


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``target`` and those incoming rows whose key is new; of incoming rows with one key the first by ``order``, of those with a null key all."""
    return target.unionByName(new_rows(target, incoming, keys, order), allowMissingColumns=True)


def new_rows(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows that ``insert_ignore`` adds."""
    return _first(incoming, keys, order).join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], replace: list[str], keep: list[str], order: list[Column]) -> DataFrame:
    """Rows of either side by key: ``replace`` columns prefer the incoming value, ``keep`` columns the old one. Rows with a null key meet no other and all stay."""
    new = _first(incoming, keys, order)
    cols = [c for c in target.columns if c not in keys]
    t, n = target.alias("t"), new.alias("n")
    joined = t.join(n, [F.col(f"t.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    pick = lambda c: F.coalesce(f"n.{c}", f"t.{c}") if c in replace else F.coalesce(f"t.{c}", f"n.{c}")
    has = set(new.columns)
    return joined.select(*[F.coalesce(f"t.{k}", f"n.{k}").alias(k) for k in keys], *[(pick(c) if c in has and c in replace + keep else F.col(f"t.{c}")).alias(c) for c in cols])


def insert_counters(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column], by: str) -> DataFrame:
    """(by, found, inserted, known): per feed the incoming rows, those that an insert adds and those whose key is there already."""
    found = incoming.groupBy(by).agg(F.count(F.lit(1)).alias("found"))
    added = new_rows(target, incoming, keys, order).groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).alias("inserted")
    return found.join(added, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "found", n, (F.col("found") - F.coalesce("n", F.lit(0))).alias("known"))


def upsert_articles(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """By url: new title, publisher, source and date, but the old text and id."""
    return upsert(target, incoming, ["url"], ["title", "publisher", "ingestion_source", "published_date"], ["id", "raw_text"], [F.col("id")])


def upsert_contradictions(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """By pair: the new score and time of update, the first time of detection."""
    return upsert(target, incoming, ["fact1_id", "fact2_id"], ["contradiction_score", "updated_at", "detection_method"], ["detected_at"], [F.desc("contradiction_score")])


def enqueue(queue: DataFrame, articles: DataFrame) -> DataFrame:
    """A PENDING row without attempts for every article that isn't queued."""
    new = articles.select(F.col("id").alias("article_id"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"))
    return insert_ignore(queue, new, ["article_id"], [F.col("article_id")])


def advance_queue(queue: DataFrame, scraped: DataFrame, classified: DataFrame) -> DataFrame:
    """PENDING becomes SCRAPED for articles in ``scraped``, SCRAPED becomes CLASSIFIED for those in ``classified`` (article_id)."""
    s = scraped.select("article_id").distinct().withColumn("__s", F.lit(True))
    c = classified.select("article_id").distinct().withColumn("__c", F.lit(True))
    status = F.when((F.col("status") == "PENDING") & F.col("__s"), "SCRAPED").when((F.col("status") == "SCRAPED") & F.col("__c"), "CLASSIFIED").otherwise(F.col("status"))
    return queue.join(s, "article_id", "left").join(c, "article_id", "left").withColumn("status", status).drop("__s", "__c")


def archive_old(articles: DataFrame, now: str, days: int = 90, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(live, archived): the ``limit`` oldest rows processed more than ``days`` ago leave the table."""
    old = articles.where(F.col("processed_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))
    archived = old.orderBy("processed_at", "id").limit(limit)
    return articles.join(archived.select("id"), "id", "left_anti"), archived


def add_column_default(df: DataFrame, name: str, value) -> DataFrame:
    old = F.col(name) if name in df.columns else F.lit(None)
    return df.withColumn(name, F.coalesce(old, F.lit(value)))


def reset(df: DataFrame) -> DataFrame:
    """An empty table of the same schema, to overwrite one with."""
    return df.limit(0)
