"""The view of facts over documents and vectors: what travels, and what is in it."""

from __future__ import annotations

import re

import pytest

from factgraph import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_small_tables(spark):
    """Tables as large as on a cluster: none is broadcast unless its rows are bounded."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for c, v in old.items():
        spark.conf.set(c, v)


def test_documents_do_not_travel(spark, no_small_tables):
    for columns in (["id", "subject"], ["id", "embedding"], ["*"]):
        plan = fx.facts(spark, SF).select(*columns)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and not re.search(r"Exchange hashpartitioning", plan)
        assert not re.search(r"(?m)^.*Exchange.*\n.*split\(text", plan)


def test_words_of_a_text(spark, tmp_path):
    texts = ["", "a", "a b c d e", "a b c d e f  g\nh ", " a\n\nb  ", "a b ", "a b c d e ", "a b c d e\n"]
    path = f"{tmp_path}/sf"
    spark.createDataFrame(list(enumerate(texts)) + [(500, None)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, [float(i)]) for i in range(9)] + [(700, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    spark.range(3).withColumnRenamed("id", "page_id").write.parquet(f"{path}/pages.parquet")
    got = {r["id"]: (r["subject"], r["predicate"], r["object"], r["embedding"]) for r in fx.facts(spark, path).collect()}
    want = {}
    for i, t in list(enumerate(texts)) + [(500, "")]:
        w = re.split("[ \n]+", t)
        want[i] = (w[0], w[1] if len(w) > 1 else "", " ".join(w[2:5]), [float(i % 500)])
    assert got == want
