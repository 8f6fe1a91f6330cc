"""Tables in buckets and digests of buckets: what isn't touched stays, what agrees isn't joined."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from factgraph.operators import buckets, tables
from factgraph.plans import consistency

ROW = "url string, id long, title string, text string"


def files(path):
    return {f.relative_to(path): (f.stat().st_mtime_ns, f.stat().st_size) for f in Path(path).rglob("rows/__bucket=*/*.parquet")}


def rows_of(df):
    return sorted((tuple(r) for r in df.select("url", "id", "title", "text").collect()), key=repr)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(f"u{i}", i, f"t{i}", "x") for i in range(400)] + [(None, 900, "null", "n")], ROW)
    buckets.create(old, path, ["url"], 64)
    assert rows_of(buckets.read(spark, path)) == rows_of(old)
    before = files(path)
    new = spark.createDataFrame([("u7", 1007, "new", "y"), ("v1", 1001, "fresh", "z"), ("v1", 1000, "first", "z"), (None, 901, "null too", "n")], ROW)
    buckets.upsert_into(spark, path, new, ["title"], ["id", "text"], [F.col("id")])
    want = tables.upsert(old, new, ["url"], ["title"], ["id", "text"], [F.col("id")])
    assert rows_of(buckets.read(spark, path)) == rows_of(want)
    after = files(path)
    touched = {f.parent for f in set(after.items()) ^ set(before.items()) for f in [f[0]]}
    assert 1 <= len(touched) <= 3  # those of u7, of v1 and of the null key
    assert all(after[f] == x for f, x in before.items() if f.parent not in touched) and len(after) >= 50


def test_insert_adds_to_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(f"u{i}", i, f"t{i}", "x") for i in range(100)], ROW)
    buckets.create(old, path, ["url"], 16)
    before = files(path)
    new = spark.createDataFrame([("u7", 1007, "ignored", "y"), ("v1", 1001, "second", "z"), ("v1", 1000, "first", "z")], ROW)
    for _ in range(2):  # a call that is made again adds nothing
        buckets.insert_into(spark, path, new, [F.col("id")])
        assert rows_of(buckets.read(spark, path)) == rows_of(tables.insert_ignore(old, new, ["url"], [F.col("id")]))
    assert before.items() <= files(path).items()


def test_buckets_that_agree_are_not_joined(spark):
    one, other = spark.range(20_000), spark.range(1, 20_001).selectExpr("IF(id = 20000, 77777, id) AS id")
    text = lambda df: df.select(F.col("id").cast("string"))
    assert consistency.differing(text(one), text(other)).count() == 2
    assert sorted((r["id"], r["type"]) for r in consistency.consistency_diff(one, other).collect()) == [("0", "ORPHANED"), ("77777", "MISSING")]
    twice = one.unionByName(one.limit(5))
    assert consistency.consistency_diff(twice, one).count() == 0 and consistency.differing(text(one), text(one.repartition(7))).count() == 0
    assert consistency.consistency_diff(one.limit(0), one.limit(3)).count() == 3
