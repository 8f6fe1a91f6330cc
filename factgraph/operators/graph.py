"""The property graph as vertex and edge tables: publishing, walks and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import percent_text
from ..functions.text import first_text


def build_vertices(articles: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per label and id; a fact's text defaults to its statement."""
    text = F.coalesce(F.nullif(F.col("text"), F.lit("")) if "text" in facts.columns else F.lit(None), F.concat_ws(" ", "subject", "predicate", "object"))
    none = F.lit(None).cast("string")
    f = facts.select(F.lit("Fact").alias("label"), "id", text.alias("text"), "subject", "predicate", "object", "confidence", none.alias("title"), none.alias("url"), none.alias("date"), F.lit(None).cast("boolean").alias("is_reference"))
    a = articles.select(F.lit("Article").alias("label"), "id", none.alias("text"), none.alias("subject"), none.alias("predicate"), none.alias("object"), F.lit(None).cast("double").alias("confidence"), "title", "url", F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "is_reference")
    both = f.unionByName(a)
    rest = [c for c in both.columns if c not in ("label", "id")]
    return both.groupBy("label", "id").agg(F.max(F.struct(*rest)).alias("v")).select("label", "id", "v.*")


def build_assertion_edges(assertions: DataFrame, articles: DataFrame, facts: DataFrame) -> DataFrame:
    """(src, dst, type) of articles and the facts that they assert or echo, where both ends are published."""
    e = assertions.select(F.col("article_id").alias("src"), F.when(F.col("is_original"), F.col("fact_id")).otherwise(F.col("provenance_id")).alias("dst"))
    e = e.join(articles.select(F.col("id").alias("src")), "src", "left_semi").join(facts.select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.distinct().select("src", "dst", F.lit("ASSERTED").alias("type"))


def build_contradiction_edges(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """One edge per unordered pair of published facts; the latest detection's score is its weight."""
    p = pairs.select(F.least("fact1_id", "fact2_id").alias("src"), F.greatest("fact1_id", "fact2_id").alias("dst"), "contradiction_score", "detection_method", "detected_at")
    for end in ("src", "dst"):
        p = p.join(facts.select(F.col("id").alias(end)), end, "left_semi")
    last = F.struct("detected_at", "contradiction_score", "detection_method")
    return p.groupBy("src", "dst").agg(F.max(last).alias("m")).select("src", "dst", F.lit("CONTRADICTS").alias("type"), F.col("m.contradiction_score").alias("weight"), F.col("m.detection_method").alias("method"))


def _asserting(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, article_id) of the articles that assert each fact."""
    return edges.where("type = 'ASSERTED'").select(F.col("dst").alias("id"), F.col("src").alias("article_id")).join(ids.select("id").distinct(), "id", "left_semi").distinct()


def fact_with_articles(ids: DataFrame, facts: DataFrame, articles: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, statement, confidence, articles): each fact with the sorted ids of the articles that assert it."""
    own = facts.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.concat_ws(" ", "subject", "predicate", "object").alias("statement"), "confidence")
    by = _asserting(ids, edges).join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("article_id")).alias("articles"))
    return own.join(by, "id", "left").withColumn("articles", F.coalesce("articles", F.array().cast("array<bigint>")))


def fact_subgraph(ids: DataFrame, facts: DataFrame, articles: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge elements around each fact: (center, kind, id, source, target, label, confidence)."""
    own = facts.join(ids.select("id").distinct(), "id", "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    center = own.select(F.col("id").alias("center"), F.lit("Fact").alias("kind"), "id", none("long").alias("source"), none("long").alias("target"), F.concat_ws(" ", "subject", "predicate", "object").alias("label"), percent_text(F.col("confidence")).alias("confidence"))
    by = _asserting(own.select("id"), edges).join(articles.select(F.col("id").alias("article_id"), "title"), "article_id")
    nodes = by.select(F.col("id").alias("center"), F.lit("Article").alias("kind"), F.col("article_id").alias("id"), none("long").alias("source"), none("long").alias("target"), first_text(F.col("title")).alias("label"), none("string").alias("confidence"))
    links = by.select(F.col("id").alias("center"), F.lit("edge").alias("kind"), none("long").alias("id"), F.col("article_id").alias("source"), F.col("id").alias("target"), F.lit("ASSERTED").alias("label"), none("string").alias("confidence"))
    return center.unionByName(nodes).unionByName(links)


def _labelled(edges: DataFrame) -> DataFrame:
    """Edges with the labels of their ends: only ASSERTED starts at an article."""
    return edges.select("src", "dst", "type", F.when(F.col("type") == "ASSERTED", "Article").otherwise("Fact").alias("src_label"), F.lit("Fact").alias("dst_label"))


def neighbors(ids: DataFrame, vertices: DataFrame, edges: DataFrame, limit: int = 25) -> DataFrame:
    """(label, id, other_label, other_id, type, rank): undirected one-hop neighbours of each (label, id), ``limit`` at most; a node without any is returned once."""
    e = _labelled(edges)
    out = e.selectExpr("src_label AS label", "src AS id", "dst_label AS other_label", "dst AS other_id", "type")
    back = e.selectExpr("dst_label AS label", "dst AS id", "src_label AS other_label", "src AS other_id", "type")
    w = Window.partitionBy("label", "id").orderBy("other_label", "other_id", "type")
    near = out.unionByName(back).join(ids.select("label", "id").distinct(), ["label", "id"], "left_semi").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    own = vertices.select("label", "id").join(ids.select("label", "id").distinct(), ["label", "id"], "left_semi")
    return own.join(near, ["label", "id"], "left")


def merge_elements(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides' elements; of one key the first side's."""
    both = first.withColumn("__side", F.lit(0)).unionByName(second.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "__side"]
    return both.groupBy(*keys).agg(F.min(F.struct("__side", *rest)).alias("m")).select(*keys, *[F.col(f"m.{c}") for c in rest])


def contradictions_all(facts: DataFrame, edges: DataFrame, min_confidence: float = 0.5, limit: int = 50) -> DataFrame:
    """The weightiest contradictions between confident facts."""
    e = edges.where("type = 'CONTRADICTS'").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
    sure = facts.where(F.col("confidence") > min_confidence)
    for end in ("a", "b"):
        e = e.join(sure.select(F.col("id").alias(end), F.col("confidence").alias(f"{end}_confidence")), end)
    return e.select("a", "b", "weight", "a_confidence", "b_confidence").orderBy(F.desc("weight"), "a", "b").limit(limit)


def contradictions_of(ids: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts that the given facts contradict, in the edges' direction."""
    e = edges.where("type = 'CONTRADICTS'").select(F.col("src").alias("id"), F.col("dst").alias("other_id"), "weight").join(ids.select("id").distinct(), "id", "left_semi")
    other = facts.select(F.col("id").alias("other_id"), F.concat_ws(" ", "subject", "predicate", "object").alias("statement"), "confidence")
    return e.join(other, "other_id").select("id", "other_id", "statement", "confidence", "weight")


def fact_history(ids: DataFrame, facts: DataFrame, articles: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, statement, predecessor_id, evolved_to_id, sources): neighbours by EVOLVES_TO and the distinct titles of asserting articles."""
    own = facts.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.concat_ws(" ", "subject", "predicate", "object").alias("statement"), "confidence")
    evolves = edges.where("type = 'EVOLVES_TO'")
    after = evolves.select(F.col("src").alias("id"), F.col("dst").alias("evolved_to_id"))
    before = evolves.select(F.col("dst").alias("id"), F.col("src").alias("predecessor_id"))
    titles = _asserting(own.select("id"), edges).join(articles.select(F.col("id").alias("article_id"), "title"), "article_id").groupBy("id").agg(F.array_sort(F.collect_set("title")).alias("sources"))
    return own.join(after, "id", "left").join(before, "id", "left").join(titles, "id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def evolve(ids: DataFrame, edges: DataFrame, max_depth: int | None = None, edge_types: tuple[str, ...] = ("EVOLVES_TO",), limit: int | None = None) -> DataFrame:
    """(start_id, id, distance, path): outgoing paths from each fact without repeated nodes, of any length or up to ``max_depth`` steps.

    A join per step over the edges of the given types; it ends as soon as a step finds nothing. With a ``limit``, the
    first paths of each start by (distance, id, path): paths come in order of distance, so a start that has its number
    leaves the front, and no more than that number of a step's paths are kept for it. The front stays below ``limit``
    paths a start, however dense the graph.
    """
    from ..staging import staged

    step = edges.where(F.col("type").isin(*edge_types)).select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    step = staged(step, "steps")
    front = ids.select(F.col("id").alias("start_id"), F.col("id"), F.lit(0).alias("distance"), F.array("id").alias("path")).distinct()
    out, depth, first = None, 0, Window.partitionBy("start_id").orderBy("distance", "id", "path")
    best = lambda df: df if limit is None else df.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit).drop("rank")
    while max_depth is None or depth < max_depth:
        found = front.join(step, front["id"] == step["at"]).where(~F.array_contains("path", F.col("to"))).select("start_id", F.col("to").alias("id"), (F.col("distance") + 1).alias("distance"), F.concat("path", F.array("to")).alias("path"))
        front, depth = staged(best(found), "front"), depth + 1
        out = front if out is None else out.unionByName(front)
        if front.isEmpty():
            break
        if limit is not None:
            full = out.groupBy("start_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit).select("start_id")
            front = front.join(full, "start_id", "left_anti")
    return best(out)


def count_nodes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes, facts, articles, reference articles and assertions."""
    v = vertices.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("label") == "Fact").alias("facts"), F.count_if(F.col("label") == "Article").alias("articles"), F.count_if((F.col("label") == "Article") & F.col("is_reference")).alias("references"))
    return v.crossJoin(edges.agg(F.count_if(F.col("type") == "ASSERTED").alias("assertions")))  # one row each


def relationship_stats(edges: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct articles and facts of assertions, assertions, and assertions per article in whole numbers."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    row = edges.where("type = 'ASSERTED'").agg(distinct("src").alias("articles"), distinct("dst").alias("facts"), F.count(F.lit(1)).alias("assertions"))
    return row.withColumn("per_article", F.expr("assertions div nullif(articles, 0)"))


def relationship_types(edges: DataFrame) -> DataFrame:
    """Counts by type of the edges that leave a fact."""
    return edges.where("type <> 'ASSERTED'").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def distinct_labels(vertices: DataFrame) -> DataFrame:
    return vertices.select("label").distinct().orderBy("label")


def list_facts(facts: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return facts.select("id", "subject", "predicate", "object", "confidence").orderBy(F.desc("confidence"), "id").offset(offset).limit(limit)


def list_articles(articles: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return articles.select("id", "title", "url", "published_date").orderBy(F.desc_nulls_first("published_date"), "id").offset(offset).limit(limit)


def page_bounds(limit: int | None, offset: int | None, strict: bool = True) -> tuple[int, int]:
    """Checked paging arguments: 1 to 100 rows, an offset of 0 to 1,000,000; the lenient form falls back to 20 and 0."""
    good = lambda x, lo, hi: isinstance(x, int) and lo <= x <= hi
    if strict and not (good(limit, 1, 100) and good(offset, 0, 1_000_000)):
        raise ValueError("limit must be 1..100 and offset 0..1000000")
    return (limit if good(limit, 1, 100) else 20), (offset if good(offset, 0, 1_000_000) else 0)


def sample_assertions(facts: DataFrame, articles: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    e = edges.where("type = 'ASSERTED'").select(F.col("src").alias("article_id"), F.col("dst").alias("fact_id"))
    rows = e.join(articles.select(F.col("id").alias("article_id"), "title", "is_reference"), "article_id").join(facts.select(F.col("id").alias("fact_id"), F.concat_ws(" ", "subject", "predicate", "object").alias("statement")), "fact_id")
    return rows.orderBy("article_id", "fact_id").limit(n).select("article_id", "fact_id", "title", "statement", "is_reference")


def export_claim_review(ids: DataFrame, facts: DataFrame, articles: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, jsonld): each fact and its articles as a schema.org ClaimReview."""
    by = _asserting(ids, edges).join(articles.select(F.col("id").alias("article_id"), "title", "url"), "article_id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("article_id").alias("id"), "title", "url"))).alias("sources"))
    own = facts.join(ids.select("id").distinct(), "id", "left_semi").join(by, "id", "left")
    rating = F.struct(F.lit("Rating").alias("@type"), F.col("confidence").alias("ratingValue"), F.lit(1.0).alias("bestRating"), F.lit(0.0).alias("worstRating"))
    item = F.struct(F.lit("CreativeWork").alias("@type"), F.coalesce("sources", F.array().cast("array<struct<id:bigint,title:string,url:string>>")).alias("sources"))
    doc = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ClaimReview").alias("@type"), F.concat_ws(" ", "subject", "predicate", "object").alias("factReviewed"), rating.alias("reviewRating"), item.alias("itemReviewed"))
    return own.select("id", F.to_json(doc).alias("jsonld"))


def empty_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Empty vertex and edge tables, to overwrite a graph with."""
    from ..schemas import EDGES, VERTICES

    return spark.createDataFrame([], VERTICES), spark.createDataFrame([], EDGES)
