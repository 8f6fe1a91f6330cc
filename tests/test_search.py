"""Batch search against plain loops: the trigram index, hybrid scores with unknown confidences, slices."""

from __future__ import annotations

import random

import numpy as np
import pytest

from factgraph.operators import search
from factgraph.staging import staged

FACT = "id long, subject string, predicate string, object string, confidence double, embedding array<double>"
QUERY = "query_id long, query string, embedding array<double>"


def facts_of(n=80, seed=2, nulls=()):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé漢") for _ in range(rng.randint(1, 5)))
    rows = []
    for i in range(n):
        v = None if i % 11 == 0 else [rng.gauss(0, 1) for _ in range(4)]
        rows.append((i, word(), None if i % 13 == 0 else word().upper(), f"{word()} {word()}", None if i in nulls else (i * 37 % 101) / 100, v))
    return rows


def queries_of(seed=3):
    rng = random.Random(seed)
    text = ["abc", "a", "", "  ", None, "ABCD ab", "漢", "é漢a", "zzzz", "b a c d", "abc abc", "dé dab\tcab", "cab a"]
    return [(q, t, None if q % 4 == 0 else [rng.gauss(0, 1) for _ in range(4)]) for q, t in enumerate(text)]


def held(fact, fields):
    one = " ".join(x for x in fact[1:4] if x is not None)
    return "\x01".join([one, *(fact[1 + ("subject", "predicate", "object").index(f)] for f in fields if fact[1 + ("subject", "predicate", "object").index(f)] is not None)]).lower()


def found(df):
    rows = [(r["query_id"], r["id"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("parts", [10_000, 3])
def test_trigram_search_equals_a_scan(spark, monkeypatch, parts):
    monkeypatch.setattr(search, "QUERIES", parts)
    facts, queries = facts_of(), queries_of()
    f, q = spark.createDataFrame(facts, FACT), spark.createDataFrame(queries, QUERY)
    text = [(x[0], held(x, search.FIELDS)) for x in facts]
    words = lambda t: (t or "").lower().split()[:10]
    assert found(search.keyword_any(q, f)) == {(k, i) for k, t, _ in queries for i, h in text if any(w in h for w in words(t))}
    two = [(x[0], held(x, ("subject", "object"))) for x in facts]
    assert found(search.phrase_match(q, f)) == {(k, i) for k, t, _ in queries if t is not None for i, h in two if t.lower() in h}


def test_long_words_meet_facts_by_equality(spark):
    f = staged(spark.createDataFrame(facts_of(), FACT), "facts")
    q = staged(spark.createDataFrame([(1, "abc dab", None), (2, "cab", None)], QUERY), "queries")
    plan = search.keyword_any(q, f)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" in plan


def test_trigrams(spark):
    row = spark.createDataFrame([("abcabc",), ("ab",), ("",), (None,), ("漢字é",)], "t string").select(search.trigrams(search.F.col("t")).alias("g")).collect()
    assert [r["g"] for r in row] == [["abc", "bca", "cab"], [], [], [], ["漢字é"]]


def hybrid(facts, queries, k, weight=0.5, least=0.0):
    out = {}
    for q, t, qv in queries:
        hits = []
        for x in facts:
            near = None
            if qv is not None and x[5] is not None:
                a, b = np.array(qv), np.array(x[5])
                near = float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
            phrase = t is not None and t.lower() in held(x, search.FIELDS)
            if not phrase and not (near is not None and near > least):
                continue
            c = x[4]
            if c is None:
                hits.append((1, 0.0, x[0]))
                continue
            score = (near * weight if near is not None and near > least else 0.0) + (c * (1 - weight) if phrase else 0.0)
            score *= c * (1.2 if c > 0.8 else 1.0) * (1.5 if c > 0.9 else 1.0)
            hits.append((0, -round(score, 6), x[0]))
        out[q] = [(i, None if n else -s) for n, s, i in sorted(hits)[:k]]
    return out


@pytest.mark.parametrize("k", [3, 10, 15, 70, None])
@pytest.mark.parametrize("n_null", [0, 10, 79])
def test_hybrid_keeps_hits_of_unknown_confidence(spark, monkeypatch, k, n_null):
    monkeypatch.setattr(search, "SLICE", 5)
    monkeypatch.setattr(search, "CELLS", 150)
    facts, queries = facts_of(nulls=set(range(0, 80, 8) if n_null == 10 else range(n_null))), queries_of()
    got = search.search_hybrid(spark.createDataFrame(queries, QUERY), spark.createDataFrame(facts, FACT).repartition(3), k=k)
    want = hybrid(facts, queries, k)
    of = {}
    for r in got.collect():
        of.setdefault(r["query_id"], []).append((r["id"], r["relevance"]))
    for q, rows in want.items():
        order = sorted(of.get(q, []), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        assert len(order) == len(rows)
        assert all((a[1] is None) == (b[1] is None) and abs((a[1] or 0) - (b[1] or 0)) < 2e-6 for a, b in zip(order, rows))
        assert {i for i, s in order if s is None} == {i for i, s in rows if s is None}


def test_vector_search_in_slices(spark, monkeypatch):
    facts, queries = facts_of(), queries_of()
    f, q = spark.createDataFrame(facts, FACT), spark.createDataFrame(queries, QUERY)
    whole = {(r["query_id"], r["id"], r["relevance"]) for r in search.search_vector(q, f, 0.2).collect()}
    monkeypatch.setattr(search, "SLICE", 2)
    monkeypatch.setattr(search, "CELLS", 7)
    assert whole and {(r["query_id"], r["id"], r["relevance"]) for r in search.search_vector(q, f, 0.2).collect()} == whole
