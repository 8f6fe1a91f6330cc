"""The logical tables as views over the given tables, in Spark, and the same views as DuckDB SQL for oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that time-dependent operators are run at.
NOW = "2024-01-31 00:00:00"
TOPICS = ["Education", "Environment", "Health", "Human Interest", "Labour", "Religion", "Society", "Sport", "Weather", "Politics and Government"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _n_pages(spark: SparkSession, sf: str) -> DataFrame:
    return F.broadcast(table(spark, sf, "pages").agg(F.count(F.lit(1)).alias("n_pages")))  # one row


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), "url",
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("publisher"),
        F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1), r"<[^>]*>", " ").alias("raw_text"),
        F.expr("CASE WHEN page_id % 4 = 0 THEN 'GDELT' ELSE 'RSS_TRUSTED' END").alias("ingestion_source"),
        F.expr("TIMESTAMP'2024-01-01' + make_interval(0,0,0,0,int(page_id*7919%720))").alias("published_date"),
        F.expr("IF(page_id % 5 = 0, NULL, TIMESTAMP'2023-10-01' + make_interval(0,0,0,int(page_id % 120)))").alias("processed_at"),
        F.expr("double(page_id % 11) / 10").alias("trust_score"),
        F.expr("page_id % 25 = 0").alias("is_reference"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Of a text no more than its first words goes on. A fact's vector is one of those whose ids are remainders of 500: few, so the documents stay where they are read."""
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "[ \n]+", 6).alias("t"), F.expr("doc_id % 500").alias("vec_id"))
    d = d.select(
        "doc_id", "vec_id", F.expr("coalesce(try_element_at(t,1),'')").alias("subject"), F.expr("coalesce(try_element_at(t,2),'')").alias("predicate"),
        F.expr("concat_ws(' ', slice(t,3,3))").alias("object"))
    e = table(spark, sf, "embeddings").where("vec_id BETWEEN -499 AND 499").select("vec_id", "embedding")
    d = d.crossJoin(_n_pages(spark, sf)).join(F.broadcast(e), "vec_id")  # 999 rows at most
    return d.select(
        F.col("doc_id").alias("id"), F.expr("doc_id % n_pages").alias("article_id"), "subject", "predicate", "object", F.expr("double((doc_id*37)%101)/100").alias("confidence"),
        F.expr("TIMESTAMP'2024-01-01' + make_interval(0,0,0,0,int(doc_id%720))").alias("created_at"),
        F.expr("doc_id % 3 <> 0").alias("is_original"), F.expr("IF(doc_id % 3 = 0 AND doc_id % 2 = 0, doc_id + 1, NULL)").alias("provenance_id"),
        F.expr("IF(doc_id % 7 = 0, NULL, TIMESTAMP'2024-01-15')").alias("checked_at"),
        F.col("embedding").cast("array<double>").alias("embedding"))


def queue(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("article_id"), F.expr("CASE page_id % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'SCRAPED' ELSE 'CLASSIFIED' END").alias("status"), F.lit(0).alias("attempts"))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TOPICS)), "id long, name string")


def article_topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where("page_id % 3 <> 0").select(F.col("page_id").alias("article_id"), F.expr("page_id % 10").alias("topic_id"), F.expr("double(page_id % 7 + 3)/10").alias("confidence"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(1, "Com", "https://www.example.com/feed", 9.0), (2, "Net", "http://example.net/rss", 8.0), (3, "Org", "https://example.org/", 7.0)], "position int, name string, url string, trust_score double")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").crossJoin(_n_pages(spark, sf)).select("conv_id", "turn", "text", F.expr("(conv_id + turn) % n_pages").alias("page_id"))
    return c.join(table(spark, sf, "pages").select("page_id", "url"), "page_id").select(F.col("conv_id").alias("claim_id"), F.col("turn").alias("rank"), F.col("text").alias("snippet"), "url")


def external_hits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("doc_id % 17 = 0").select(F.col("doc_id").alias("fact_id"), F.lit(1).alias("rank"), F.expr("concat('https://ext.example/', doc_id)").alias("url"), F.expr("concat('hit ', doc_id)").alias("title"), F.expr("TIMESTAMP'2023-12-01'").alias("date"))


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.expr("coalesce(try_element_at(split(text,'[ \n]+'),2),'')").alias("query"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return b.join(e, "query_id")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("k"))
    ids = lambda c: d.select(F.col("k").alias(c))
    asserted = d.crossJoin(_n_pages(spark, sf)).selectExpr("k % n_pages AS src", "k AS dst", "'ASSERTED' AS type", "CAST(NULL AS DOUBLE) AS weight")
    against = d.where("k % 10 = 0").selectExpr("k AS src", "k + 1 AS dst", "'CONTRADICTS' AS type", "double(k % 13)/13 AS weight").join(ids("dst"), "dst", "left_semi")
    evolves = d.where("k % 3 = 0 AND k % 12 <> 9").selectExpr("k AS src", "k + 3 AS dst", "'EVOLVES_TO' AS type", "CAST(NULL AS DOUBLE) AS weight").join(ids("dst"), "dst", "left_semi")
    return asserted.unionByName(against).unionByName(evolves)


def stance_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.expr("concat(text, CASE doc_id % 4 WHEN 0 THEN ' hoax' WHEN 1 THEN ' verified' WHEN 2 THEN ' hoax verified' ELSE '' END)").alias("snippet"))


_DUCK = {
    "articles": r"""SELECT page_id AS id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        regexp_extract(url, '^https?://([^/?#]+)', 1) AS publisher,
        regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g') AS raw_text,
        CASE WHEN page_id % 4 = 0 THEN 'GDELT' ELSE 'RSS_TRUSTED' END AS ingestion_source,
        TIMESTAMP '2024-01-01' + to_hours(page_id*7919%720) AS published_date,
        CASE WHEN page_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2023-10-01' + to_days((page_id % 120)::INT) END AS processed_at,
        (page_id % 11)::DOUBLE / 10 AS trust_score, page_id % 25 = 0 AS is_reference FROM pages""",
    "facts": r"""SELECT doc_id AS id, doc_id % (SELECT count(*) FROM pages) AS article_id, coalesce(t[1], '') AS subject, coalesce(t[2], '') AS predicate,
        array_to_string(t[3:5], ' ') AS object, ((doc_id*37)%101)::DOUBLE/100 AS confidence, TIMESTAMP '2024-01-01' + to_hours(doc_id%720) AS created_at,
        doc_id % 3 <> 0 AS is_original, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN doc_id + 1 END AS provenance_id,
        CASE WHEN doc_id % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-01-15' END AS checked_at, e.embedding::DOUBLE[] AS embedding
        FROM (SELECT doc_id, string_split_regex(text, '[ \n]+') AS t FROM documents) d JOIN embeddings e ON e.vec_id = d.doc_id % 500""",
    "queue": "SELECT page_id AS article_id, CASE page_id % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'SCRAPED' ELSE 'CLASSIFIED' END AS status, 0::INT AS attempts FROM pages",
    "topics": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(TOPICS)) + ") v(id, name)",
    "article_topics": "SELECT page_id AS article_id, page_id % 10 AS topic_id, (page_id % 7 + 3)::DOUBLE/10 AS confidence FROM pages WHERE page_id % 3 <> 0",
    "sources": "SELECT * FROM (VALUES (1, 'example.com', 9.0::DOUBLE), (2, 'example.net', 8.0::DOUBLE), (3, 'example.org', 7.0::DOUBLE)) v(position, host, trust_score)",
    "evidence": "SELECT conv_id AS claim_id, turn AS rank, text AS snippet, url FROM (SELECT *, (conv_id + turn) % (SELECT count(*) FROM pages) AS p FROM conversations) c JOIN pages ON page_id = p",
    "external_hits": "SELECT doc_id AS fact_id, 1 AS rank, 'https://ext.example/' || doc_id AS url, 'hit ' || doc_id AS title, TIMESTAMP '2023-12-01' AS date FROM documents WHERE doc_id % 17 = 0",
    "queries": r"SELECT item_id AS query_id, coalesce(string_split_regex(text, '[ \n]+')[2], '') AS query, embedding::DOUBLE[] AS embedding FROM benchmark JOIN embeddings ON vec_id = item_id",
    "edges": """SELECT doc_id % (SELECT count(*) FROM pages) AS src, doc_id AS dst, 'ASSERTED' AS type, NULL::DOUBLE AS weight FROM documents
        UNION ALL SELECT doc_id, doc_id + 1, 'CONTRADICTS', (doc_id % 13)::DOUBLE/13 FROM documents WHERE doc_id % 10 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents)
        UNION ALL SELECT doc_id, doc_id + 3, 'EVOLVES_TO', NULL FROM documents WHERE doc_id % 3 = 0 AND doc_id % 12 <> 9 AND doc_id + 3 IN (SELECT doc_id FROM documents)""",
    "stance_texts": "SELECT doc_id AS id, text || CASE doc_id % 4 WHEN 0 THEN ' hoax' WHEN 1 THEN ' verified' WHEN 2 THEN ' hoax verified' ELSE '' END AS snippet FROM documents",
}


def duck(body: str) -> str:
    """DuckDB SQL with the views that ``body`` names as ``<view>_fx``."""
    used = [v for v in _DUCK if re.search(rf"\b{v}_fx\b", body)]
    views = ", ".join(f"{v}_fx AS ({_DUCK[v]})" for v in used)
    body = body.strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {body[14:]}"
    return f"WITH {views}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {views} {body}"
