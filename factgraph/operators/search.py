"""Batch search: a table of queries against the facts.

Words and phrases are looked up through an inverted index of trigrams: a fact that holds a word holds all of its
trigrams, so a word meets the facts of its rarest trigram by an equi-join, and only those are looked at. Words of fewer
than three characters have no trigram; they are held against every fact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import truthrank
from ..functions.text import keywords
from ..functions.vectors import cosine_similarity
from ..staging import short_batches, staged

#: Queries that are matched at a time: a larger table is matched in as many parts.
QUERIES = 10_000
#: Queries whose scores are at hand at a time, and numbers of one matrix of scores at most, in a task.
SLICE, CELLS = 256, 1 << 20
#: Fields that phrase and keyword searches look at.
FIELDS = ("subject", "predicate", "object")
HIT = ["query_id", "id", "subject", "predicate", "object", "confidence", "relevance"]


def _text(facts: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Facts with one lower-cased text per field; fields are parted by a character that no keyword holds."""
    return facts.withColumn("__text", F.lower(F.concat_ws("\u0001", F.concat_ws(" ", "subject", "predicate", "object"), *fields)))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text, in one pass over it; none of a shorter one."""
    chars = F.split(text, "")
    from_ = lambda k: F.slice(chars, F.lit(k), F.size(chars))
    join = lambda x, y: F.concat(x, y)  # noqa: E731  null past the end, as one side is shorter
    runs = F.array_compact(F.array_distinct(F.zip_with(F.zip_with(chars, from_(2), join), from_(3), join)))
    return F.when(F.length(text) >= 3, runs).otherwise(F.array().cast("array<string>"))


def _rarest(words: DataFrame, facts: DataFrame) -> DataFrame:
    """(word, gram): for each word (word) the trigram that the fewest facts (__text) have; none for a word with a trigram that no fact has."""
    grams = staged(words.select("word", F.explode(trigrams(F.col("word"))).alias("gram")), "grams")
    wanted = grams.select("gram").distinct()
    # the postings' lengths: counted before the shuffle, of wanted trigrams only
    counted = facts.select(F.explode(trigrams(F.col("__text"))).alias("gram")).join(F.broadcast(wanted), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    each = grams.join(counted, "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    return staged(each.where("m.n > 0").select("word", "m.gram"), "rarest")


def _parts(queries: DataFrame) -> list[DataFrame]:
    """The queries in parts of about QUERIES rows, by a hash of their id: one part where they are few."""
    parts = -(-queries.count() // QUERIES) or 1
    return [queries] if parts == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k) for k in range(parts)]


def _match(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts (with __text) that hold any of a query's ``__words``, once for each query, with the query's other columns.

    The query side is broadcast in parts of a checked size. A fact that holds several of a query's words counts for the
    first of them only, so no pair has to be sorted out afterwards.
    """
    rest = [c for c in queries.columns if c != "__words"]
    held = lambda words: F.filter(words, lambda w: F.contains("__text", w))
    found = []
    for part in _parts(queries):
        each = staged(part.select(*rest, "__words", F.explode(F.array_distinct("__words")).alias("word")).where("word is not null"), "words")
        long, short = each.where("length(word) >= 3"), each.where("length(word) < 3")
        rarest = _rarest(long.select("word").distinct(), facts)
        probes = long.join(rarest, "word")
        posted = facts.withColumn("gram", F.explode(trigrams(F.col("__text")))).join(F.broadcast(probes), "gram")  # the words of QUERIES queries or so
        found.append(posted.where(F.contains("__text", F.col("word"))).drop("gram"))
        if not short.isEmpty():
            found.append(facts.join(F.broadcast(short), F.contains("__text", F.col("word"))))
    hits = reduce(DataFrame.unionByName, found)
    return hits.where(F.get(held(F.col("__words")), F.lit(0)) == F.col("word")).drop("word", "__words")


def _top(hits: DataFrame, k: int | None) -> DataFrame:
    if k is None:
        return hits.select(*HIT)
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*HIT)


def keyword_any(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts in which any of a query's first ten words stands."""
    return _match(queries.select("query_id", keywords(F.col("query")).alias("__words")), _text(facts)).drop("__text")


def phrase_match(queries: DataFrame, facts: DataFrame, fields: tuple[str, ...] = ("subject", "object")) -> DataFrame:
    """Facts whose text or fields hold the whole query."""
    return _match(queries.select("query_id", F.array(F.lower("query")).alias("__words")), _text(facts, fields)).drop("__text")


def search_keyword(queries: DataFrame, facts: DataFrame, k: int = 15) -> DataFrame:
    return _top(keyword_any(queries, facts).withColumn("relevance", F.col("confidence")), k)


def search_truthrank(queries: DataFrame, facts: DataFrame, k: int = 15) -> DataFrame:
    return _top(keyword_any(queries, facts).withColumn("relevance", F.col("confidence") * truthrank(F.col("confidence"))), k)


def search_phrase(queries: DataFrame, facts: DataFrame, k: int = 15) -> DataFrame:
    return _top(phrase_match(queries, facts).withColumn("relevance", F.col("confidence")), k)


def _similar(queries: DataFrame, facts: DataFrame, above: float) -> DataFrame:
    """(query_id, id, similarity) of queries and facts with vectors of one length that are more similar than ``above``.

    Each part of the query table becomes one matrix per vector length, and each task multiplies its facts' vectors with
    it, slice by slice.
    """
    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {facts.schema['id'].dataType.simpleString()}, similarity double"
    vectors = facts.where("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("v"))

    def against(part: DataFrame) -> DataFrame:
        sides = _matrices(part)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _sliced(batches):
                for n, rows in b.groupby(b["v"].map(len)):
                    if n in sides:
                        ids, unit = sides[n]
                        own = _unit(rows["v"])
                        for k in range(0, len(ids), SLICE):
                            scores = own @ unit[k : k + SLICE].T
                            i, j = np.nonzero(scores > above)
                            yield pd.DataFrame({"query_id": ids[k + j], "id": rows["id"].to_numpy()[i], "similarity": scores[i, j]})

        return vectors.mapInPandas(run, types)

    short_batches(facts.sparkSession)
    return reduce(DataFrame.unionByName, [against(part) for part in _parts(queries.where("embedding IS NOT NULL"))])


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of so few rows that a matrix of them and SLICE queries has at most CELLS numbers."""
    step = max(1, CELLS // SLICE)
    for b in batches:
        for k in range(0, len(b), step):
            yield b.iloc[k : k + step].reset_index(drop=True)


def _matrices(queries: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The ids and unit vectors of a part of the queries, by vector length; its size is bounded by QUERIES."""
    rows = queries.select("query_id", F.col("embedding").cast("array<double>").alias("v")).toPandas()
    return {int(n): (part["query_id"].to_numpy(), _unit(part["v"])) for n, part in rows.groupby(rows["v"].map(len))} if len(rows) else {}


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; a vector without length stays 0, and is similar to none."""
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def search_vector(queries: DataFrame, facts: DataFrame, min_sim: float = 0.7, k: int = 15) -> DataFrame:
    """Facts at least ``min_sim`` similar to the query's vector; vectors without length are similar to none."""
    near = _similar(queries, facts, min_sim - 1e-12).withColumn("relevance", F.round("similarity", 6))
    if k is not None:
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id"))).where(F.col("rank") <= k)
    return near.join(facts, "id").select(*HIT)


class _Hybrid:
    """One part of the queries inside a task: scores of facts against a slice of queries at a time, and the best of each query so far."""

    def __init__(self, rows: pd.DataFrame, vector_weight: float, min_sim: float, k: int | None) -> None:
        self.ids, self.weight, self.min_sim, self.k = rows["query_id"].to_numpy(), vector_weight, min_sim, k
        vs = rows["v"].tolist()
        self.vectors = {n: [j for j, v in enumerate(vs) if v is not None and len(v) == n] for n in {len(v) for v in vs if v is not None and len(v)}}
        self.units = {n: _unit(rows["v"].iloc[at]) for n, at in self.vectors.items()}
        self.phrases: dict[str, list[int]] = {}
        for j, q in enumerate(rows["q"]):
            if isinstance(q, str):
                self.phrases.setdefault(q, []).append(j)
        self.automaton = ahocorasick.Automaton()
        for q, at in self.phrases.items():
            if q:
                self.automaton.add_word(q, at)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.best = np.full((len(rows), k), -np.inf) if k is not None else None

    def phrase_hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(fact, query) of every fact that holds a query's phrase; one walk along each text finds all phrases."""
        everywhere = self.phrases.get("", [])
        i, j = [], []
        for row, text in enumerate(texts):
            held = {id(at): at for _, at in self.automaton.iter(text)} if len(self.automaton) else {}
            for at in (*held.values(), everywhere):
                i += [row] * len(at)
                j += at
        return np.array(i, dtype=np.int64), np.array(j, dtype=np.int64)

    def scored(self, b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(fact, query, score) of hits that may be among a query's best; a score is NaN where the fact's confidence is unknown."""
        confidence, boost = b["confidence"].to_numpy(dtype=float), b["boost"].to_numpy(dtype=float)
        of_fact = np.array([0 if v is None else len(v) for v in b["v"]])
        fact, query = self.phrase_hits(b["__text"].tolist())
        order = np.argsort(query, kind="stable")
        fact, query = fact[order], query[order]
        own = {n: (np.flatnonzero(of_fact == n), _unit(b["v"].loc[of_fact == n])) for n in self.vectors if (of_fact == n).any()}
        rank = b["id"].argsort().argsort().to_numpy()
        for k in range(0, len(self.ids), SLICE):
            n = min(SLICE, len(self.ids) - k)
            score, hit = np.zeros((len(b), n)), np.zeros((len(b), n), dtype=bool)
            for size, (i, unit) in own.items():
                at = np.array(self.vectors[size])
                inside = np.flatnonzero((at >= k) & (at < k + n))
                if len(inside):
                    near = unit @ self.units[size][inside].T
                    cells = np.ix_(i, at[inside] - k)
                    hit[cells] = near > self.min_sim
                    score[cells] = np.where(near > self.min_sim, near * self.weight, 0.0)
            lo, hi = np.searchsorted(query, [k, k + n])
            i, j = fact[lo:hi], query[lo:hi] - k
            hit[i, j] = True
            score[i, j] += confidence[i] * (1 - self.weight)
            score *= (confidence * boost)[:, None]
            for q in np.flatnonzero(hit.any(axis=0)):
                found = np.flatnonzero(hit[:, q])
                value = score[found, q]
                if self.k is not None:
                    keep = self._among_best(k + q, value, rank[found])
                    found, value = found[keep], value[keep]
                if len(found):
                    yield found, np.full(len(found), k + q), value

    def _among_best(self, q: int, value: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which of a query's hits can be among its best. Scores that are unknown come behind all others, by id; ties after rounding stay."""
        known = ~np.isnan(value)
        top = np.sort(np.concatenate([self.best[q], value[known]]))[-self.k :] if self.k else value[:0]
        if not self.k:
            return np.zeros(len(value), dtype=bool)
        self.best[q] = top
        keep = known & (np.where(known, value, -np.inf) >= top[0] - 1e-6)
        if np.isinf(top[0]):  # fewer than k with a score so far
            unknown = np.flatnonzero(~known)
            keep[unknown[np.argsort(rank[unknown])[: self.k]]] = True
        return keep


def search_hybrid(queries: DataFrame, facts: DataFrame, vector_weight: float = 0.5, min_sim: float = 0.0, k: int | None = 15) -> DataFrame:
    """Phrase hits and vector hits, each fact once per query; a missing score is 0; confident facts are boosted.

    A fact's vector score, phrase score and boost are all at hand where the fact is, so a task scores its facts against
    all queries, a slice of queries at a time, and only what is among a query's best ``k`` so far leaves it. A fact whose
    confidence is null is a hit without relevance, behind the others.
    """
    slim = _text(facts).select("id", "subject", "predicate", "object", "confidence", F.col("embedding").cast("array<double>").alias("v"), "__text", truthrank(F.col("confidence")).alias("boost"))
    id_type = facts.schema["id"].dataType.simpleString()
    columns = ["id", "subject", "predicate", "object", "confidence"]
    types = f"id {id_type}, subject string, predicate string, object string, confidence double, query_id {queries.schema['query_id'].dataType.simpleString()}, relevance double"

    def against(part: DataFrame) -> DataFrame:
        rows = part.select("query_id", F.lower("query").alias("q"), F.col("embedding").cast("array<double>").alias("v")).toPandas()  # QUERIES rows or so

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = _Hybrid(rows, vector_weight, min_sim, k)
            for b in _sliced(batches):
                found = list(own.scored(b))
                if found:
                    fact, query, score = (np.concatenate(x) for x in zip(*found))
                    yield b[columns].iloc[fact].assign(query_id=own.ids[query], relevance=score)

        return slim.mapInPandas(run, types)

    short_batches(facts.sparkSession)
    hits = reduce(DataFrame.unionByName, [against(part) for part in _parts(queries)])
    return _top(hits.withColumn("relevance", F.round(F.nanvl("relevance", F.lit(None).cast("double")), 6)), k)


def search_hybrid_filtered(queries: DataFrame, facts: DataFrame, vector_weight: float = 0.5, k: int = 15) -> DataFrame:
    """Phrase hits only, scored by confidence and similarity."""
    q = queries.select("query_id", F.array(F.lower("query")).alias("__words"), F.col("embedding").alias("__qv"))
    hits = _match(q, _text(facts, ("subject", "object")))
    score = F.col("confidence") * (1 - vector_weight) + F.coalesce(cosine_similarity(F.col("embedding"), F.col("__qv")), F.lit(0.0)) * vector_weight
    return _top(hits.withColumn("relevance", F.round(score, 6)), k)


def search(queries: DataFrame, facts: DataFrame, dim: int, k: int = 15, min_sim: float = 0.65) -> DataFrame:
    """Queries with a vector of ``dim`` numbers go to the hybrid search, with another vector to the vector search, without one to the keyword search."""
    size = F.when(F.col("embedding").isNull(), 0).otherwise(F.size("embedding"))
    part = lambda c: queries.where(c)
    return search_hybrid(part(size == dim), facts, k=k).unionByName(search_vector(part((size != dim) & (size > 0)), facts, min_sim, k)).unionByName(search_keyword(part(size == 0), facts, k))


def verify(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, found, id, statement, confidence): each claim with its most confident phrase hit, if any."""
    hits = phrase_match(claims, facts)
    best = hits.groupBy("query_id").agg(F.max(F.struct(F.col("confidence"), (-F.col("id")).alias("o"), F.col("id"), F.concat_ws(" ", "subject", "predicate", "object").alias("statement"))).alias("b"))
    return claims.select("query_id").join(best, "query_id", "left").select("query_id", F.col("b").isNotNull().alias("found"), F.col("b.id").alias("id"), F.col("b.statement").alias("statement"), F.col("b.confidence").alias("confidence"))
