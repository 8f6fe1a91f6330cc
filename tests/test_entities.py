"""Entities of long texts leave a task in short batches."""

from __future__ import annotations

from factgraph.operators import hooks
from factgraph.staging import BYTES_PER_BATCH


def test_entities_in_short_batches(spark, monkeypatch):
    monkeypatch.setattr(hooks, "ENTITIES", 7)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = [" x ".join(f"Name{i}" for i in range(40)), None, "", "none here", "Ab Cd x Ef"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = [tuple(r) for r in hooks.extract_entities(df).collect()]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BYTES_PER_BATCH)
    want = [(0, f"Name{i}", "ORG", i, texts[0].index(f"Name{i} " if i < 39 else "Name39")) for i in range(40)]
    assert sorted(got) == sorted([*want, (4, "Ab Cd", "ORG", 0, 0), (4, "Ef", "ORG", 1, 8)])
