"""Readers of event dumps, feeds, trusted-source lists and tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..staging import short_batches
from .main_text import outside_boilerplate


def event_rows(spark: SparkSession, path: str) -> DataFrame:
    """(n, mentions, url) of every line of a tab-separated event dump: its number of fields, field 31 as a number, and its last field."""
    cols = F.split("value", "\t")
    return spark.read.text(path).select(F.size(cols).alias("n"), F.expr("try_cast(get(split(value, '\t'), 31) AS INT)").alias("mentions"), F.element_at(cols, -1).alias("url"))


def read_event_dump(spark: SparkSession, path: str, min_mentions: int = 10) -> DataFrame:
    """(url, mentions) of event rows with at least 50 fields, enough mentions and an http url. ``counters.ingest_event_dump`` counts the others, too."""
    return event_rows(spark, path).where((F.col("n") >= 50) & (F.col("mentions") >= min_mentions) & F.startswith("url", F.lit("http"))).select("url", "mentions")


def read_feed_items(spark: SparkSession, path: str, source_name: str, now: str) -> DataFrame:
    """(url, title, publisher, raw_text, published_date) of feed items with a title and an http link; ``now`` where the date is missing."""
    schema = "title string, link string, summary string, description string, pubDate string"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    blank = lambda c: F.nullif(stripped(F.col(c)), F.lit(""))
    day = F.regexp_replace(F.regexp_replace("pubDate", r"^\s*[A-Za-z]{3},\s*", ""), r"(?:GMT|UTC|UT|Z)\s*$", "+0000")  # without the day's name
    date = F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate"), F.lit(now).cast("timestamp"))
    rows = items.select(F.col("link").alias("url"), blank("title").alias("title"), F.lit(source_name).alias("publisher"), F.coalesce(blank("summary"), blank("description"), F.lit("")).alias("raw_text"), date.alias("published_date"))
    return rows.where(F.col("title").isNotNull() & F.startswith("url", F.lit("http")))


def read_trusted_sources(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, url, category, trust_score) of a JSON document with a list ``trusted_sources``."""
    schema = "trusted_sources array<struct<name:string,url:string,category:string,trust_score:double>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("trusted_sources").alias("position", "s")).select("position", "s.*")


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table in any format that Spark reads, JDBC included."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def _main_text():
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda html: outside_boilerplate(html) if isinstance(html, str) else None)

    return F.pandas_udf("string")(run)


def extract_main_text(pages: DataFrame, min_chars: int = 200) -> DataFrame:
    """(page_id, title, text, published) of pages whose main text is longer than ``min_chars``: scripts, styles, comments, navigation, lists of links and tags go, however they nest."""
    short_batches(pages.sparkSession)
    body = _main_text()("html")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    text = stripped(F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r"\s*\n\s*", "\n"))
    meta = F.regexp_extract("html", r"(?is)<meta[^>]+(?:article:published_time|datePublished|pubdate)[^>]*content=[\"']([^\"']+)", 1)
    time = F.regexp_extract("html", r"(?is)<time[^>]+datetime=[\"']([^\"']+)", 1)
    rows = pages.select("page_id", F.regexp_extract("html", r"(?is)<title>([^<]*)</title>", 1).alias("title"), text.alias("text"), F.try_to_timestamp(F.coalesce(F.nullif(meta, F.lit("")), F.nullif(time, F.lit("")))).alias("published"))
    return rows.where(F.length("text") > min_chars)
