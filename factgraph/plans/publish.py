"""From tables to the published graph, and the whole batch pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contradictions, gates, graph, hooks, provenance, similarity, tables, trust
from ..schemas import EDGES, VERTICES
from ..staging import staged


def publish_graph(facts: DataFrame, articles: DataFrame, article_topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of what passes the gates; without facts or articles it stops."""
    f, a = gates.gate_facts(facts), gates.gate_articles(articles, article_topics)
    if f.isEmpty() or a.isEmpty():
        raise ValueError("nothing to publish: no facts or no articles pass the gates")
    return graph.build_vertices(a, f), graph.build_assertion_edges(gates.gate_assertions(facts, articles), a, f)


def export_payload(facts: DataFrame, articles: DataFrame, assertions: DataFrame, path: str) -> None:
    """JSON files of the three tables, with ISO dates."""
    iso = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    for name, df in (("facts", facts), ("articles", articles), ("assertions", assertions)):
        df.write.mode("overwrite").options(**iso).json(f"{path}/{name}")


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices by label and edges by type, as Parquet."""
    vertices.write.mode("overwrite").partitionBy("label").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The (vertices, edges) that ``write_graph`` wrote."""
    return spark.read.schema(VERTICES).parquet(f"{path}/vertices"), spark.read.schema(EDGES).parquet(f"{path}/edges")


def run_pipeline(articles: DataFrame, sources: DataFrame, article_topics: DataFrame, now: str, model: hooks.Batch | None = None, threshold: float = 0.05) -> dict[str, DataFrame]:
    """Trust, facts, deduplication, provenance and contradictions of processed articles: the tables by name."""
    scored = staged(trust.score_trust(articles, sources), "articles")
    found = hooks.extract_facts(scored.select("id", F.col("raw_text").alias("text")), model=model)
    rows = found.withColumnRenamed("id", "article_id").withColumns({"id": F.xxhash64("article_id", "position"), "confidence": F.lit(0.5), "text": F.concat_ws(" ", "subject", "predicate", "object"), "created_at": F.lit(now).cast("timestamp")})
    facts = staged(hooks.embed(gates.valid_triples(rows)).drop("text", "position"), "facts")
    facts = staged(facts.join(similarity.dedup_facts(facts, threshold).where("kept").select("id"), "id", "left_semi"), "facts")
    traced = provenance.trace_provenance(facts, scored).withColumn("checked_at", F.when(F.col("checked"), F.lit(now).cast("timestamp")))
    facts = staged(facts.join(traced.drop("checked"), "id"), "facts")
    pairs = contradictions.detect(facts, scored, now, backfill=True)
    live, archived = tables.archive_old(scored, now)
    vertices, edges = publish_graph(facts, scored, article_topics)
    return {"articles": live, "archive": archived, "facts": facts, "contradictions": pairs, "vertices": vertices, "edges": edges}
