"""Queue state by key, and rows that streams drop as late."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import functions as F

from factgraph.operators import tables
from factgraph.streaming import streams

EVENT = "article_id long, stage string"
QUEUE = "article_id long, status string, attempts int, note string"


def arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def test_queue_state_goes_on_and_touches_only_its_keys(spark, tmp_path):
    inbox, folder = str(tmp_path / "inbox"), str(tmp_path / "queue")
    queue = spark.createDataFrame([(i, ("PENDING", "SCRAPED", "CLASSIFIED")[i % 3], None if i == 4 else 0, "n") for i in range(40)] + [(None, "PENDING", 0, "n")], QUEUE)
    want = queue
    for rows in ([(0, "SCRAPED"), (0, "SCRAPED"), (1, "CLASSIFIED"), (2, "SCRAPED"), (99, "SCRAPED"), (None, "SCRAPED")], [(0, "CLASSIFIED"), (3, "CLASSIFIED"), (4, "SCRAPED"), (4, "CLASSIFIED")], [(3, "SCRAPED"), (3, "CLASSIFIED"), (6, None)]):
        arrive(spark, inbox, rows, EVENT)
        batch = spark.createDataFrame(rows, EVENT)
        got = streams.queue_state(streams.read_files(spark, f"{inbox}/*.parquet", EVENT), queue, folder)
        want = tables.advance_queue(want, batch.where("stage = 'SCRAPED'"), batch.where("stage = 'CLASSIFIED'"))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    changes = spark.read.parquet(f"{folder}/changes").where("change = 'MOVED'").collect()
    assert sorted((r["article_id"], r["status"]) for r in changes) == [(0, "CLASSIFIED"), (0, "SCRAPED"), (1, "CLASSIFIED"), (3, "SCRAPED"), (4, "CLASSIFIED")]  # 5 rows of 41 were ever written


def test_articles_that_wait_are_reported(spark, tmp_path):
    inbox, folder = str(tmp_path / "inbox"), str(tmp_path / "queue")
    queue = spark.createDataFrame([(1, "PENDING", 0, ""), (2, "PENDING", 0, ""), (3, "SCRAPED", 0, "")], QUEUE)
    read = lambda: streams.read_files(spark, f"{inbox}/*.parquet", EVENT)
    arrive(spark, inbox, [(2, "SCRAPED")], EVENT)
    streams.queue_changes(read(), queue, folder, patience=50)
    time.sleep(0.2)
    arrive(spark, inbox, [(9, "SCRAPED")], EVENT)
    found = streams.queue_changes(read(), queue, folder, patience=50).where("change = 'WAITING'").select("article_id", "status").distinct().collect()
    assert [tuple(r) for r in found] == [(1, "PENDING")]


def test_late_rows_are_those_that_rates_drops(spark, tmp_path):
    inbox, folder = str(tmp_path / "inbox"), str(tmp_path / "late")
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    schema = "id long, ts timestamp, value double"
    arrivals = [[(1, at(0), 1.0), (2, at(5), 1.0), (3, None, 1.0)], [(4, at(0, 10), 1.0), (5, at(0, 20), 1.0), (6, at(3, 10), 1.0), (7, at(4, 10), 1.0), (8, at(7), 1.0)], [(9, at(5), 1.0), (10, at(6, 10), 1.0)]]
    stream = lambda: streams.read_files(spark, f"{inbox}/*.parquet", schema)
    kept = None
    for rows in arrivals:
        arrive(spark, inbox, rows, schema)
        got = streams.late_rows(stream(), "ts", "30 minutes", "1 hour", folder)
        kept = streams.run_available(streams.rates(stream(), "ts", [], "30 minutes", delay="1 hour"), "update", str(tmp_path / "rates"))
    counted = kept.groupBy("start").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    total = got.agg(F.sum("arrived").alias("arrived"), F.sum("counted").alias("counted"), F.sum("dropped_groups").alias("groups")).first()
    # 4, 5 (one window) and 6 are over when the second batch comes, 9 when the third does
    assert (total["arrived"], total["counted"]) == (9, 5) and counted == 5
    assert total["groups"] == 3
    again = streams.late_rows(stream(), "ts", "30 minutes", "1 hour", folder).agg(F.sum("arrived").alias("a"), F.sum("counted").alias("c")).first()
    assert (again["a"], again["c"]) == (9, 5)
