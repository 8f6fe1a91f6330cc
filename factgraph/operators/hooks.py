"""Model hooks: a caller's function over a batch of rows, with Spark's partitioning; defaults are deterministic expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import heuristic_stance
from ..functions.text import fact_statement, sentences, smart_cut, stripped
from ..functions.vectors import cosine_similarity, norm
from ..staging import short_batches

#: Topic prototypes that are broadcast at a time.
PROTOTYPES = 1000
#: Entities that a task hands on at a time.
ENTITIES = 20_000
Batch = Callable[[pd.DataFrame], pd.DataFrame]


def apply_model(df: DataFrame, model: Batch, schema: str) -> DataFrame:
    """``model`` over each Arrow batch; its result has ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Hashed word counts of unit length; null for a text without words."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.conv(F.left(F.md5(w), F.lit(8)), 16, 10).cast("long"), F.lit(dim)))
    # bound variables are evaluated once each; an expression used twice would be evaluated for each element
    counts = F.aggregate(slots, F.array_repeat(F.lit(0.0), dim), lambda acc, s: F.transform(acc, lambda x, i: x + F.when(i == s, 1.0).otherwise(0.0)))
    sized = F.transform(F.array(counts), lambda c: F.struct(c.alias("c"), norm(c).alias("n")))
    unit = F.transform(sized, lambda v: F.transform(v["c"], lambda x: (x / v["n"]).cast("float")))
    return F.when(F.size(words) > 0, F.get(unit, F.lit(0)))


def embed(df: DataFrame, text_col: str = "text", model: Batch | None = None, dim: int = 64) -> DataFrame:
    """Rows with an ``embedding``; a model returns the whole row and a null vector where it fails."""
    if model is not None:
        return apply_model(df, model, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", embedding array<float>")
    return df.withColumn("embedding", hashed_embedding(F.col(text_col), dim))


def classify_topics(articles: DataFrame, prototypes: DataFrame, least: float = 0.4) -> DataFrame:
    """(article_id, topic_id, confidence): the topic whose prototype (topic_id, embedding) is nearest, if similar enough; of equals the least id.

    Prototypes are broadcast in parts of about PROTOTYPES, each scored in a pass of its own, so none is left out.
    """
    parts = -(-prototypes.count() // PROTOTYPES) or 1
    dealt = prototypes.select("topic_id", F.col("embedding").alias("p"), F.pmod(F.xxhash64("topic_id"), F.lit(parts)).alias("part"))
    own = articles.where("embedding IS NOT NULL").select(F.col("id").alias("article_id"), "embedding")
    rows = None
    for k in range(parts):
        pairs = own.crossJoin(F.broadcast(dealt.where(F.col("part") == k).select("topic_id", "p")))
        scored = pairs.select("article_id", F.struct(cosine_similarity(F.col("embedding"), F.col("p")).alias("score"), (-F.col("topic_id")).alias("o"), "topic_id").alias("b"))
        rows = scored if rows is None else rows.unionByName(scored)
    best = rows.groupBy("article_id").agg(F.max("b").alias("b"))
    return best.where(F.col("b.score") > least).select("article_id", "b.topic_id", F.col("b.score").alias("confidence"))


def topic_prototypes(vectors: DataFrame) -> DataFrame:
    """(topic_id, embedding): the mean vector of each topic's members (topic_id, embedding)."""
    means = vectors.select("topic_id", F.posexplode("embedding").alias("i", "x")).groupBy("topic_id", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


def extract_facts(df: DataFrame, text_col: str = "text", model: Batch | None = None) -> DataFrame:
    """(id, position, subject, predicate, object): by default each sentence's first word, second word and the three after them."""
    if model is not None:
        return apply_model(df, model, "id long, position int, subject string, predicate string, object string")
    s = df.select("id", F.posexplode(F.split(F.col(text_col), r"\. ")).alias("position", "s"))
    w = s.select("id", "position", F.filter(F.split(stripped(F.col("s")), r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") >= 3)
    return w.select("id", "position", F.get("w", 0).alias("subject"), F.get("w", 1).alias("predicate"), F.array_join(F.slice("w", 3, 3), " ").alias("object"))


def extract_claims(df: DataFrame, text_col: str = "text", model: Batch | None = None) -> DataFrame:
    """(id, position, claim): by default the long enough sentences of the cut text."""
    if model is not None:
        return apply_model(df, model, "id long, position int, claim string")
    return df.select("id", F.posexplode(sentences(smart_cut(F.col(text_col)))).alias("position", "claim"))


def score_nli(pairs: DataFrame, model: Batch | None = None) -> DataFrame:
    """Pairs with ``contradiction_score``: by default 0.9 where subject and predicate agree and one side is negated or their numbers differ, else 0.1."""
    if model is not None:
        return apply_model(pairs, model, ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes) + ", contradiction_score double")
    negated = lambda c: F.rlike(F.lower(c), F.lit(r"\b(not|no|never|none|nor)\b|n't\b"))
    numbers = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"\d+"), 0))
    same = (F.lower("subject1") == F.lower("subject2")) & (F.lower("predicate1") == F.lower("predicate2"))
    differ = (negated(F.col("text1")) != negated(F.col("text2"))) | ((F.size(numbers(F.col("text1"))) > 0) & (F.size(numbers(F.col("text2"))) > 0) & (numbers(F.col("text1")) != numbers(F.col("text2"))))
    return pairs.withColumn("contradiction_score", F.when(pairs["text1"].isNull() | pairs["text2"].isNull(), F.lit(None).cast("double")).when(same & differ, 0.9).otherwise(0.1))


def stance(df: DataFrame, snippet_col: str = "snippet", model: Batch | None = None) -> DataFrame:
    if model is not None:
        return apply_model(df, model, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", stance string")
    return df.withColumn("stance", heuristic_stance(F.col(snippet_col)))


#: Runs of capitalised words; other words are matched too, so that no run starts inside of one.
ENTITY, WORD = r"\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)*", r"[\p{L}\p{N}_]+"


def extract_entities(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, text, type, position, start): runs of capitalised words, with the place of each in the text; a text's own column is read, one pass a row.

    A task holds a short batch of texts and ENTITIES entities, however many rows it has and however long a text is.
    """
    find, entity, most = regex.compile(f"{ENTITY}|{WORD}"), regex.compile(ENTITY), ENTITIES

    def found(b: pd.DataFrame) -> Iterator[tuple]:
        for id_, text in zip(b["id"], b["text"]):
            runs = (m for m in find.finditer(text or "") if entity.fullmatch(m.group()))
            yield from ((id_, m.group(), "ORG", i, m.start()) for i, m in enumerate(runs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = found(b)
            while rows := list(islice(own, most)):
                yield pd.DataFrame(rows, columns=["id", "text", "type", "position", "start"])

    short_batches(df.sparkSession)
    id_type = df.schema["id"].dataType.simpleString()
    return df.select("id", F.col(text_col).alias("text")).mapInPandas(run, f"id {id_type}, text string, type string, position int, start int")


def unique_entities(entities: DataFrame) -> DataFrame:
    """Of the entities (id, text, type, position, start) of one text and type, whatever their case, the first."""
    w = Window.partitionBy("id", F.lower("text"), "type").orderBy("start", "position")
    return entities.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "position")


def pair_texts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (fact1_id, fact2_id) with the subjects, predicates and statements of both."""
    side = lambda n: facts.select(F.col("id").alias(f"fact{n}_id"), F.col("subject").alias(f"subject{n}"), F.col("predicate").alias(f"predicate{n}"), fact_statement(F.col("subject"), F.col("predicate"), F.col("object")).alias(f"text{n}"))
    return pairs.select("fact1_id", "fact2_id").join(side(1), "fact1_id").join(side(2), "fact2_id")
