"""Counters that are gathered while tables are written."""

from __future__ import annotations

from pyspark.sql import functions as F

from factgraph.operators import counters


def test_event_dump_counts_every_line(spark, tmp_path):
    line = lambda mentions, url, n=52: "\t".join([*["x"] * 31, str(mentions), *["y"] * (n - 33), url])
    lines = [line(10, "http://a"), line(9, "http://b"), line("?", "http://c"), line(50, "http://d", 40), line(50, "BBC"), line(12, "http://a"), line(99, "http://known"), "", line(11, "http://e")]
    (tmp_path / "dump.csv").write_text("\n".join(lines))
    target = spark.createDataFrame([("http://known",)], "url string")
    got = counters.ingest_event_dump(spark, str(tmp_path / "dump.csv"), target, str(tmp_path / "out"))
    assert got == {"read": 9, "malformed": 3, "skipped": 1, "other": 1, "inserted": 2, "known": 2}
    rows = spark.read.parquet(str(tmp_path / "out/articles")).collect()
    assert sorted((r["url"], r["mentions"]) for r in rows) == [("http://a", 12), ("http://e", 11)]


def test_rows_that_are_counted_and_not_written(spark, tmp_path):
    got = counters.write_counted(spark.range(1000, numPartitions=4).toDF("id"), str(tmp_path / "t"), where=F.col("id") % 2 == 0, even=F.col("id") % 2 == 0, all=F.lit(True))
    assert got == {"even": 500, "all": 1000} and spark.read.parquet(str(tmp_path / "t")).count() == 500


def test_dedup_and_contradictions(spark, tmp_path):
    facts = spark.createDataFrame([(i, f"s{i}") for i in range(6)], "id long, subject string")
    judged = facts.selectExpr("id", "id % 3 <> 0 AS kept")
    assert counters.write_deduplicated(facts, judged, str(tmp_path / "f")) == {"new": 4, "duplicate": 2}
    assert spark.read.parquet(str(tmp_path / "f")).columns == ["id", "subject"]
    pairs = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.6), (5, 6, 0.7)], "fact1_id long, fact2_id long, score double")
    assert counters.write_contradictions(pairs, pairs.limit(1), str(tmp_path / "p")) == {"found": 3, "new": 2, "updated": 1}
    assert counters.write_contradictions(pairs.limit(0), pairs, str(tmp_path / "q")) == {"found": 0, "new": 0, "updated": 0}
