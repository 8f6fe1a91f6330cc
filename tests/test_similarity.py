"""The metric partition of vectors against brute force, and how many blocks it lets meet."""

from __future__ import annotations

import math

import numpy as np
import pytest

from factgraph.operators import similarity


def clustered(n_clusters, each, dim=16, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    m = np.repeat(centres, each, axis=0) + rng.normal(size=(n_clusters * each, dim)) * spread
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")


def reps(df):
    return df.select(df["id"].alias("rep"))


def pairs_of(df):
    return {(r["a"], r["b"]): r["distance"] for r in df.collect()}


def brute(m, low, high, closed=False):
    d = 1 - m @ m.T
    return {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if low - 1e-12 <= d[i, j] and (d[i, j] < high or closed and d[i, j] <= high + 1e-12)}


@pytest.mark.parametrize(("low", "high", "closed"), [(0.0, 0.05, False), (0.02, 0.3, True), (0.9, 2.0, True), (0.0, 1.1, False)])
def test_pairs_equal_brute_force(spark, monkeypatch, low, high, closed):
    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "TILE", 3)
    monkeypatch.setattr(similarity, "CHUNK", 5)
    m = np.vstack([clustered(12, 30), clustered(1, 120, spread=0.01, seed=9), np.random.default_rng(4).normal(size=(60, 16))])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = frame(spark, m)
    got = similarity.rep_pairs(df, reps(df), low, high, closed).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]) for r in got} == brute(m, low, high, closed)
    assert all(abs(r["distance"] - (1 - m[r["a"]] @ m[r["b"]])) < 1e-9 for r in got)


def met(spark, m, high):
    df = frame(spark, m)
    blocks, pivots = similarity._blocks(df, reps(df).selectExpr("rep", "true AS asks", "true AS answers"))
    blocks = similarity.staged(blocks, "blocks")
    n = blocks.count()
    return similarity.block_pairs(blocks, similarity._Bounds(pivots, 0.0, math.acos(1 - high))).count(), n * (n + 1) // 2


def test_blocks_that_cannot_meet_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 50)
    few, all_few = met(spark, clustered(10, 50), 0.02)
    many, all_many = met(spark, clustered(100, 50), 0.02)
    assert few < all_few / 2 and many < all_many / 10
    assert many < 30 * few  # ten times the vectors: all blocks would be a hundred times the pairs


def test_new_vectors_against_a_store(spark, monkeypatch):
    """The store's own pairs are not looked for, and blocks of the store never meet each other."""
    monkeypatch.setattr(similarity, "BLOCK", 40)
    store, new = clustered(8, 60), clustered(8, 3)
    both = np.vstack([store, new])
    df = frame(spark, both)
    sides = df.select(df["id"].alias("rep"), (df["id"] >= len(store)).alias("asks"), (df["id"] < len(store)).alias("answers"))
    got = set(pairs_of(similarity.rep_pairs(df, sides, 0.0, 0.05)))
    assert got == {(a, b) for a, b in brute(both, 0.0, 0.05) if a < len(store) <= b}
    near = {r["id"] for r in similarity.near_existing(frame(spark, new, 10_000), frame(spark, store), 0.05).collect()}
    assert near == {10_000 + b - len(store) for _, b in got}


def test_no_vectors(spark):
    df = frame(spark, np.zeros((0, 3)))
    assert similarity.rep_pairs(df, reps(df), 0.0, 0.5).count() == 0
    one = frame(spark, np.ones((1, 3)))
    assert similarity.rep_pairs(one, reps(one), 0.0, 0.5).count() == 0


@pytest.mark.parametrize("component", [500_000, 3])
def test_a_long_chain_is_settled_in_a_few_jobs(spark, monkeypatch, component):
    """Facts that drift along a circle: each is near its neighbours only, so whether one stays hangs on all before it."""
    n = 2000 if component > 3 else 30
    monkeypatch.setattr(similarity, "COMPONENT", component)
    monkeypatch.setattr(similarity, "BLOCK", 300)
    at = np.arange(n) * 0.003
    when = [i * 7919 % n for i in range(n)] if component == 3 else list(range(n))
    rows = [(i, f"2024-01-01 {w // 3600:02d}:{w // 60 % 60:02d}:{w % 60:02d}", [math.cos(x), math.sin(x)]) for i, (x, w) in enumerate(zip(at, when))]
    rows += [(n, "2024-01-01 00:00:00", rows[5][2]), (n + 1, "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "id long, t string, embedding array<double>").selectExpr("id", "to_timestamp(t) AS created_at", "embedding")
    made = []
    monkeypatch.setattr(similarity, "staged", lambda d, label, f=similarity.staged: made.append(label) or f(d, label))
    threshold = 1 - math.cos(0.0045)
    got = {r["id"]: r["kept"] for r in similarity.dedup_facts(df, threshold).collect()}
    kept = []
    want = {}
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = v is None or all(1 - v[0] * x[0] - v[1] * x[1] >= threshold for x in kept)
        if want[i] and v is not None:
            kept.append(v)
    assert got == want
    assert component == 3 or len(made) < 15


def test_neighbours_that_differ_by_rounding_go_by_id(spark):
    """Of two neighbours whose distances agree in nine digits the one with the smaller id comes first, though the other is nearer by a trillionth."""
    at = {1: 0.0, 2: 0.1 + 1e-11, 3: -0.1, 4: 0.4}
    df = spark.createDataFrame([(i, i != 1, [math.cos(x), math.sin(x)]) for i, x in at.items()], "id long, is_original boolean, embedding array<double>")
    for got in (similarity.knn_neighbors(df, 0.15, 1), similarity.band_candidates(df, df.where("id = 1"), 0.001, 0.15, 1)):
        assert {(r["id"], r["neighbor_id"]) for r in got.where("id = 1").collect()} == {(1, 2)}
