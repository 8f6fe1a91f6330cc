"""Operators on small literal tables: thresholds, ties, nulls, order."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.functions import scores, shapes, text, vectors
from factgraph.operators import gates, graph, hooks, provenance, similarity, tables, trust
from factgraph.sources import readers
from factgraph.streaming import streams


def column(spark, rows, schema, **exprs):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*[e.alias(n) for n, e in exprs.items()]).collect()]


def test_event_dump(spark, tmp_path):
    def line(mentions, url, n=61):
        f = ["x"] * n
        if n > 31:
            f[31] = mentions
        f[-1] = url
        return "\t".join(f)

    (tmp_path / "dump.tsv").write_text("\n".join([line("10", "http://a"), line("9", "http://b"), line("many", "http://c"), line("11", "ftp://d"), line("12", "http://e", 49), line("99", "https://f")]))
    got = readers.read_event_dump(spark, str(tmp_path / "dump.tsv"))
    assert sorted(r["url"] for r in got.collect()) == ["http://a", "https://f"]


def test_feed(spark, tmp_path):
    item = lambda t, link, extra="": f"<item><title>{t}</title><link>{link}</link>{extra}</item>"
    (tmp_path / "feed.xml").write_text("<rss>" + item("A", "http://a", "<summary>s</summary><description>d</description>") + item(" ", "http://b") + item("C", "ftp://c") + item("D", "https://d", "<description>text</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate>") + "</rss>")
    rows = {r["url"]: r for r in readers.read_feed_items(spark, str(tmp_path / "feed.xml"), "src", "2024-01-31 00:00:00").collect()}
    assert set(rows) == {"http://a", "https://d"}
    assert [rows[u]["published_date"].strftime("%Y-%m-%d %H:%M") for u in ("http://a", "https://d")] == ["2024-01-31 00:00", "2024-01-02 03:04"]
    assert rows["http://a"]["raw_text"] == "s" and rows["https://d"]["raw_text"] == "text"


def test_trusted_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"trusted_sources": [{"name": "a", "url": "http://www.x.com:80/f", "category": "c", "trust_score": 9}, {"name": "b", "url": "http://x.com:80/g", "category": "c", "trust_score": 7}]}, indent=1))
    s = readers.read_trusted_sources(spark, str(tmp_path / "s.json"))
    assert [(r["host"], r["score"]) for r in trust.domain_score_map(s).collect()] == [("x.com:80", 0.7)]


def test_trust_variants(spark):
    a = spark.createDataFrame([(1, "https://www.reuters.com/x"), (2, "https://feeds.reuters.com/y"), (3, None)], "id long, url string")
    s = spark.createDataFrame([(0, "r", "http://feeds.reuters.com/top", 10.0)], "position int, name string, url string, trust_score double")
    assert {r["id"]: r["trust_score"] for r in trust.score_trust(a, s).collect()} == {1: 0.5, 2: 1.0, 3: 0.5}
    assert {r["id"]: r["trust_score"] for r in trust.score_trust(a, s, match="registered_domain").collect()} == {1: 1.0, 2: 1.0, 3: 0.5}


def test_scores(spark):
    got = column(spark, [(0.7,), (0.71,), (0.4,), (0.41,), (0.8,), (0.9,), (0.91,)], "c double", band=scores.verdict_band(F.col("c")), boost=scores.truthrank(F.col("c")))
    assert [g["band"] for g in got[:4]] == ["DEBATED", "VERIFIED TRUE", "FALSE / UNPROVEN", "DEBATED"]
    assert [round(g["boost"], 6) for g in got[4:]] == [1.0, 1.2, 1.8]
    got = column(spark, [("short",), ("a hoax that is verified",), ("it was believed so",), ("quite accurate!",), (None,)], "s string", st=scores.heuristic_stance(F.col("s")))
    assert [g["st"] for g in got] == ["NEUTRAL", "CONTRADICT", "CONTRADICT", "SUPPORT", "NEUTRAL"]


def test_json_shapes(spark):
    got = column(spark, [('{"facts":[{"subject":"a","confidence":"x"}]}',), ('[{"subject":"b"}]',), ("broken {",), (None,)], "j string", n=F.size(shapes.parse_facts(F.col("j"))))
    assert [g["n"] for g in got][:2] == [1, 1]
    got = column(spark, [('[[{"label":"CONTRADICTION","score":0.7}]]',), ('[{"label":"contradiction","score":0.2}]',), ('{"error":"x"}',)], "j string", s=F.element_at(shapes.nli_scores(F.col("j")), "contradiction"))
    assert [g["s"] for g in got] == [0.7, 0.2, None]
    got = column(spark, [('{"labels":["a","b"],"scores":[0.4,0.6]}',), ('[{"label":"a","score":0.9},{"label":"b","score":0.1}]',), ('[{"labels":["c"],"scores":[0.5]}]',), ('{"error":1}',)], "j string", t=shapes.zero_shot_top(F.col("j")))
    assert [g["t"] and (g["t"]["label"], g["t"]["score"]) for g in got] == [("b", 0.6), ("a", 0.9), ("c", 0.5), None]


def test_vectors(spark):
    got = column(spark, [("[0.5,1]",), ("[oops",), (None,)], "t string", v=vectors.parse_vector_text(F.col("t")))
    assert [g["v"] for g in got] == [[0.5, 1.0], None, None]
    got = column(spark, [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>", s=vectors.cosine_similarity(F.col("a"), F.col("b")))
    assert [g["s"] for g in got] == [1.0, 0.0, None]


def test_smart_cut_and_sentences(spark):
    long = "A" * 3000 + ". " + "B" * 3000
    got = column(spark, [(long,), ("C" * 4000,), ("short. text",)], "t string", c=text.smart_cut(F.col("t")))
    assert [g["c"] for g in got] == ["A" * 3000 + ".", "C" * 3500, "short. text"]
    got = column(spark, [("Tiny. This one is long enough.  And this one is, too",)], "t string", s=text.sentences(F.col("t")))
    assert got[0]["s"] == ["This one is long enough", "And this one is, too"]


def test_valid_triples(spark):
    rows = [("a", "b", "c", "0.3"), ("\t", "b", "c", "0.3"), ("a", "b", "c", None), ("a", "b", "c", "high")]
    got = gates.valid_triples(spark.createDataFrame(rows, "subject string, predicate string, object string, confidence string")).collect()
    assert sorted(r["confidence"] for r in got) == [0.3, 0.5]


def test_merges_are_idempotent(spark):
    t = spark.createDataFrame([(1, "u1", "old", "text")], "id long, url string, title string, raw_text string")
    n = spark.createDataFrame([(7, "u1", "new", "other"), (8, "u2", "t", "x"), (9, "u2", "later", "y")], t.schema)
    once = tables.upsert_articles(t, n)
    want = {(1, "u1", "new", "text"), (8, "u2", "t", "x")}
    assert {(r["id"], r["url"], r["title"], r["raw_text"]) for r in once.collect()} == want
    assert {(r["id"], r["url"], r["title"], r["raw_text"]) for r in tables.upsert_articles(once, n).collect()} == want
    assert tables.insert_ignore(once, n, ["url"], [F.col("id")]).count() == 2


def unit(*degrees):
    return [[float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] for d in degrees]


@pytest.mark.parametrize("seed", range(3))
def test_dedup_is_greedy(spark, seed):
    rng = np.random.default_rng(seed)
    angles = [0, 15, 30, 30, 200, *rng.uniform(0, 360, 25)]
    rows = [(i, i % 4, v) for i, v in enumerate(unit(*angles))] + [(99, 0, None), (100, 9, None)]
    facts = spark.createDataFrame(rows, "id long, t int, embedding array<double>").withColumn("created_at", F.timestamp_seconds("t"))
    kept, want = [], {99: True, 100: True}
    for i, _, v in sorted(rows[:-2], key=lambda r: (r[1], r[0])):
        want[i] = all(1 - np.dot(v, k) >= 0.05 for k in kept)
        if want[i]:
            kept.append(v)
    assert {r["id"]: r["kept"] for r in similarity.dedup_facts(facts).collect()} == want


def test_blocks_do_not_change_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    facts = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(60, v[0].tolist())], "id long, embedding array<double>")
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if 1 - v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) < 0.6}
    for size in (7, 1000):
        monkeypatch.setattr(similarity, "BLOCK", size)
        pairs, member = similarity.similar_pairs(facts, 0.6)
        assert {(r["a"], r["b"]) for r in pairs.collect()} == want
        assert {r["id"]: r["rep"] for r in member.collect()}[60] == 0


def test_provenance(spark):
    facts = spark.createDataFrame([(1, 1, unit(0)[0]), (2, 2, unit(1)[0]), (3, 3, unit(2)[0]), (4, 4, unit(120)[0]), (5, 5, unit(240)[0])], "id long, article_id long, embedding array<double>")
    articles = spark.createDataFrame([(1, "u1", "2024-01-01"), (2, "u2", "2024-01-02"), (3, "u3", "2024-01-02"), (4, "u4", "2024-01-05"), (5, "u5", None)], "id long, url string, d string").withColumn("published_date", F.to_timestamp("d"))
    hits = spark.createDataFrame([(4, 1, "u1"), (4, 2, "u2"), (1, 1, "u3")], "fact_id long, rank int, url string")
    got = {r["id"]: r for r in provenance.trace_provenance(facts, articles, hits).collect()}
    assert (got[2]["provenance_id"], got[3]["provenance_id"]) == (1, 1)
    assert not got[1]["is_original"] and got[1]["external_source_url"] == "u3"
    assert got[4]["external_source_url"] == "u1" and got[4]["original_source_id"] == 1
    assert not got[5]["checked"] and got[5]["is_original"] is None


def test_evolve_survives_cycles(spark):
    edges = spark.createDataFrame([(1, 2, "E"), (2, 3, "E"), (3, 1, "E"), (2, 9, "X")], "src long, dst long, type string")
    got = graph.evolve(spark.createDataFrame([(1,)], "id long"), edges, edge_types=("E",)).collect()
    assert sorted(r["path"] for r in got) == [[1, 2], [1, 2, 3]]


def test_evolution_of_a_dense_graph_ends(spark, monkeypatch):
    """All pairs of 40 facts: paths without a limit would be more than 10**40; each start leaves the front with its first 25."""
    n = 40
    edges = spark.createDataFrame([(i, j, "EVOLVES_TO") for i in range(n) for j in range(n) if i != j] + [(100, 101, "EVOLVES_TO"), (101, 0, "EVOLVES_TO")], "src long, dst long, type string")
    got = graph.evolve(spark.createDataFrame([(0,), (7,), (100,), (500,)], "id long"), edges, limit=25).collect()
    of = {}
    for r in got:
        of.setdefault(r["start_id"], []).append((r["distance"], r["id"], r["path"]))
    assert sorted(of[0]) == [(1, j, [0, j]) for j in range(1, 26)]
    assert sorted(of[7]) == [(1, j, [7, j]) for j in range(26) if j != 7]
    assert sorted(of[100]) == [(1, 101, [100, 101]), (2, 0, [100, 101, 0])] + [(3, j, [100, 101, 0, j]) for j in range(1, 24)]
    assert 500 not in of


def test_page_bounds():
    assert graph.page_bounds(10, 5) == (10, 5)
    assert graph.page_bounds(0, -1, strict=False) == (20, 0)
    with pytest.raises(ValueError):
        graph.page_bounds(101, 0)


def test_late_rows_are_dropped(spark, tmp_path):
    base = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (2, "2024-01-01 05:00:00", 1.0)], "id long, t string, value double").withColumn("ts", F.to_timestamp("t"))
    late = spark.createDataFrame([(3, "2024-01-01 00:10:00", 1.0), (4, "2024-01-01 05:10:00", 1.0)], "id long, t string, value double").withColumn("ts", F.to_timestamp("t"))
    # rows are late by the watermark of the batch before theirs, which a batch in between moves on
    middle = base.where("id = 2")
    for part, df in zip("abc", (base, middle, late)):
        df.coalesce(1).write.parquet(str(tmp_path / "in" / part))
    import os
    import shutil
    import time

    folder = tmp_path / "flat"
    folder.mkdir()
    for i, part in enumerate("abc"):
        f = next((tmp_path / "in" / part).glob("*.parquet"))
        shutil.copy(f, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (time.time() - 100 + 10 * i,) * 2)
    rows = streams.read_files(spark, str(folder), base.schema, 1)
    out = streams.run_available(streams.rates(rows, "ts", [], "30 minutes", delay="1 hour"), "update")
    assert out.agg(F.max("batch")).first()[0] >= 1
    last = out.groupBy("start").agg(F.max("n").alias("n")).orderBy("start").collect()
    assert [r["n"] for r in last] == [1, 3]


def test_evolution_of_any_length(spark):
    edges = spark.createDataFrame([(i, i + 1, "EVOLVES_TO") for i in range(14)] + [(14, 3, "EVOLVES_TO")], "src long, dst long, type string")
    got = {r["id"]: r["distance"] for r in graph.evolve(spark.createDataFrame([(0,)], "id long"), edges).collect()}
    assert got == {i: i for i in range(1, 15)}
    assert graph.evolve(spark.createDataFrame([(0,)], "id long"), edges, max_depth=4).count() == 4


def test_upsert_query_merges_whole_texts(spark, monkeypatch):
    from factgraph import fixtures, registry

    sf, seen = "/root/testdata/sf0.001", []
    merge = tables.upsert_articles
    monkeypatch.setattr(tables, "upsert_articles", lambda old, new: seen.append(merge(old, new)) or seen[0])
    registry.upsert_articles(spark, sf)
    want = {r["id"]: r["raw_text"] if r["id"] % 2 == 0 else "other" for r in fixtures.articles(spark, sf).select("id", "raw_text").collect()}
    assert max(len(t or "") for t in want.values()) > 40
    assert {r["id"]: r["raw_text"] for r in seen[0].collect()} == want


def test_null_keys_conflict_with_nothing(spark):
    old = spark.createDataFrame([("a", 1), (None, 2)], "url string, id long")
    new = spark.createDataFrame([(None, 3), (None, 4), ("a", 5), ("b", 7), ("b", 6)], "url string, id long")
    rows = lambda df: sorted(((r["url"] or "", r["id"]) for r in df.select("url", "id").collect()))
    assert rows(tables.insert_ignore(old, new, ["url"], [F.col("id")])) == [("", 2), ("", 3), ("", 4), ("a", 1), ("b", 6)]
    assert rows(tables.upsert(old, new, ["url"], ["id"], [], [F.col("id")])) == [("", 2), ("", 3), ("", 4), ("a", 5), ("b", 6)]


def test_entities_stand_where_they_start(spark):
    text = "Anna-Lena met MacAnn. Then Ann left. Then Ann came, éAnn Ann_x A Bob Carol Dee2"
    rows = hooks.extract_entities(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")).collect()
    assert [(r["text"], r["start"]) for r in rows] == [("Anna", 0), ("Lena", 5), ("MacAnn", 14), ("Then Ann", 22), ("Then Ann", 37), ("Ann", text.index("Ann_x")), ("Bob Carol Dee2", text.index("Bob"))]
    assert all(text[r["start"] :].startswith(r["text"]) for r in rows)
    first = hooks.unique_entities(spark.createDataFrame(rows))
    assert {(r["text"], r["start"]) for r in first.where("text like 'Then%'").collect()} == {("Then Ann", 22)}


def test_topics_beyond_one_part(spark, monkeypatch):
    monkeypatch.setattr(hooks, "PROTOTYPES", 3)
    proto = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(10)]) for i in range(10)], "topic_id long, embedding array<double>")
    own = proto.select((F.col("topic_id") + 100).alias("id"), "embedding")
    assert {r["article_id"]: r["topic_id"] for r in hooks.classify_topics(own, proto).collect()} == {100 + i: i for i in range(10)}


def _arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_streams_go_on_after_a_restart(spark, tmp_path):
    inbox, schema = str(tmp_path / "inbox"), "key string, n long"
    read = lambda: streams.read_files(spark, f"{inbox}/*.parquet", "key string, n long")
    start = spark.createDataFrame([("a", 1)], schema)
    total = lambda state, batch: state.unionByName(batch).groupBy("key").agg(F.sum("n").alias("n"))
    for rows, sums, kept in (([("a", 2), ("b", 1), ("b", 5)], {"a": 3, "b": 6}, {"a": 1, "b": 1}), ([("b", 4), ("c", 9)], {"a": 3, "b": 10, "c": 9}, {"a": 1, "b": 1, "c": 9}), ([], {"a": 3, "b": 10, "c": 9}, {"a": 1, "b": 1, "c": 9})):
        if rows:
            _arrive(spark, inbox, rows, schema)
        assert {r["key"]: r["n"] for r in streams.each_batch(read(), start, total, str(tmp_path / "sums")).collect()} == sums
        assert {r["key"]: r["n"] for r in streams.durable_ingest(read(), start, ["key"], "n", str(tmp_path / "kept")).collect()} == kept


def test_lsh_finds_nine_in_ten(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 32))
    f = spark.createDataFrame([(i, (centres[i % 30] + 0.35 * rng.normal(size=32)).tolist()) for i in range(600)], "id long, embedding array<double>")
    pairs = lambda method: {(r["a"], r["b"]) for r in similarity.similar_pairs(f, 0.2, method)[0].collect()}
    exact, found = pairs("blocked"), pairs("lsh")
    assert len(exact) > 1000 and found <= exact and len(found) >= 0.9 * len(exact)


def test_staged_tables_go(spark):
    from factgraph import staging

    kept = staging.staged(spark.range(3), "kept")
    assert kept.count() == 3 and staging.drop_staged(spark) > 0
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()
