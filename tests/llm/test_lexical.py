"""Ranked lexical search against SQL and against plain scores of all documents."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np

from factgraph.llm import lexical
from factgraph.llm import queries as registered

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted({(i, tuple(sorted(set(words(t))))) for i, t in items}, key=repr):
        scores = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in text if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(f"select item_id, rank, doc_id, score from ({registered.ORACLE['op11_lexical']})").fetchall()
    assert result(registered.op11_lexical(spark, SF)) == sorted(want, key=repr)


def test_odd_rows_and_many_passes(spark, monkeypatch):
    docs = [(1, "Alpha beta, GAMMA-9 alpha"), (2, None), (3, ""), (4, " \n.!?\x00 "), (5, "ünï 漢字 beta\x7fbeta"), (5, "ünï 漢字 beta\x7fbeta"), (None, "alpha no id"), (7, "tick tock beta " * 70000), (8, "alpha"), (9, "alpha"), (10, "Ünï alone")]
    docs += [(100 + i, "alpha beta " * (i % 7) + f"w{i} w{i // 2} w{i // 3}") for i in range(60)]
    items = [(1, "ALPHA? beta!"), (1, "beta alpha alpha"), (1, "ünï 漢字"), (2, None), (3, "..."), (None, "gamma tock"), (4, "nowhere at all"), *[(10 + i, f"w{i} w{i // 2} beta") for i in range(12)]]
    extra = "key string, width int, item_id int, wanted int, score int"
    d = spark.createDataFrame([(i, t, "x", 0, 0, 0, 0) for i, t in docs], f"doc_id long, text string, {extra}")
    b = spark.createDataFrame([(i, t, "x", 0, 0) for i, t in items], "item_id long, text string, words string, doc_id int, bound int")
    want = plain(docs, items)
    assert result(lexical.rank(d, b)) == want
    monkeypatch.setattr(lexical, "MAX_TERMS", 8)
    assert result(lexical.rank(d, b)) == want
    assert lexical.rank(d.limit(0), b).count() == lexical.rank(d, b.limit(0)).count() == 0


def test_bounds_are_never_less_than_scores():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.3, int(n)) % 500).encode() for n in rng.integers(1, 400, 90)]
    text, term, times, n = lexical.counted(texts)
    df = Counter(term.tolist())
    names = np.array(sorted(df), dtype=np.uint64)
    weight = np.array([math.floor(1000 * math.log(182 / (2 * df[int(t)] + 1))) for t in names], dtype=np.int64)
    w = lexical._Weights(names, weight, [rng.choice(len(names), 20, replace=False) for _ in range(30)], 90, int(n.sum()))
    owner, entry = lexical.entries(text, term, times)
    block = lexical._Block(9)
    for i in range(len(texts)):
        block.keys.append(i)
        block.lengths.append(n[i])
        block.entries.append(entry[owner == i])
    packed = block.packed()
    bounds = w.bounds(packed["width"], n.astype(np.int64), np.frombuffer(packed["slices"], np.uint8).reshape(packed["width"], -1))
    for i, own in enumerate(w.items):
        for d in range(len(texts)):
            tf = dict(zip(term[text == d].tolist(), times[text == d].tolist()))
            exact = sum(int(w.part(weight[t : t + 1], np.array([tf[int(names[t])]]), np.array([n[d]]))[0]) for t in own if int(names[t]) in tf)
            assert bounds[i, d] >= exact
    assert lexical.terms("Ab\x00c9_D é") == [b"ab", b"c9", b"d", "é".encode()]
