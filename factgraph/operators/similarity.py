"""Exact similarity of vectors: a metric partition of unit vectors, products of blocks that can meet, neighbours, bands, and an optional hash-based search.

The angle between unit vectors is a metric. Every vector goes to the nearest of a sample of pivots, and the vectors of a
pivot are cut into blocks by their angle to it, so a block is a shell around its pivot. By the triangle inequality two
shells bound the angle between any two of their vectors from both sides, and blocks whose bounds are outside the wanted
distances never meet. What is left is multiplied, in tiles of blocks, so that a block travels once for several others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..staging import short_batches, staged
from .components import connected

#: Vectors in one block or so; a task multiplies two blocks at a time.
BLOCK = 2048
#: Pivots at most, numbers that all of them have at most (8 MB, which travel with each task), and sampled vectors for each pivot.
PIVOTS, PIVOT_NUMBERS, SAMPLE = 4096, 1_000_000, 4
#: Steps of the angle to a pivot by which its vectors are put in order.
STEPS = 128
#: Blocks of one side of a tile, and blocks whose bounds are compared at a time.
TILE, CHUNK = 8, 4096
#: Pairs of one component that one task settles.
COMPONENT = 500_000
#: What rounding can change in an angle.
SLACK = 1e-6
#: Digits of a distance by which neighbours are ranked: what is equal in them goes by id, however a product was summed up.
DIGITS = 9


def classes(facts: DataFrame) -> DataFrame:
    """(id, rep): facts with equal vectors share the least id among them as representative. Null and zero vectors are left out."""
    v = facts.where("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("v")).where(norm(F.col("v")) > 0).withColumn("key", F.xxhash64("v"))
    reps = v.groupBy("key", "v").agg(F.min("id").alias("rep"))
    return v.join(reps, ["key", "v"]).select("id", "rep")


def _pivots(v: DataFrame, n: int) -> np.ndarray:
    """Unit vectors out of a sample of ``v`` (id, v), one for each BLOCK of the ``n`` rows and never more than the bounds allow.

    Half of them are as the sample comes, so that dense places have more; each of the others is the vector farthest from
    all before it, so that no far cluster goes without.
    """
    first = v.select(F.size("v")).first()
    if not first:
        return np.ones((1, 1))
    k = max(1, min(math.ceil(n / BLOCK), PIVOTS, PIVOT_NUMBERS // max(first[0], 1)))
    m = np.array([r["v"] for r in v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * k).select("v").collect()], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    chosen = list(range((k + 1) // 2))
    near = (m @ m[chosen].T).max(axis=1)
    while len(chosen) < min(k, len(m)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, m @ m[chosen[-1]])
    return m[chosen]


def _blocks(facts: DataFrame, reps: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(block, pivot, asks, answers, near, far, ids, units) of blocks of unit vectors packed as bytes, and the pivots.

    ``near`` and ``far`` are the least and the largest angle between a vector of the block and its pivot. A block has
    BLOCK vectors or so, however many share a pivot: each vector takes a random place among those of its step.
    """
    v = facts.select("id", F.col("embedding").cast("array<double>").alias("v")).join(reps.withColumnRenamed("rep", "id"), "id")
    pivots = _pivots(v.select("id", "v"), reps.count())

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 1024):
                part = b.iloc[k : k + 1024]
                m = np.stack(part["v"].to_numpy())
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
                near = m @ pivots.T
                at = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(m)), at], -1, 1))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "pivot": at, "asks": part["asks"].to_numpy(), "answers": part["answers"].to_numpy(), "angle": angle, "unit": [x.astype("<f8").tobytes() for x in m]})

    short_batches(facts.sparkSession)
    cell = ["pivot", "asks", "answers"]
    placed = v.select("id", "asks", "answers", "v").mapInPandas(place, "id long, pivot int, asks boolean, answers boolean, angle double, unit binary")
    placed = staged(placed.withColumn("step", F.floor(F.col("angle") / (math.pi / STEPS)).cast("int")), "placed")
    steps = placed.groupBy(*cell, "step").agg(F.count(F.lit(1)).alias("n"))  # pivots x steps rows at most
    before = F.sum("n").over(Window.partitionBy(*cell).orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    ranked = placed.join(steps.withColumn("before", F.coalesce(before, F.lit(0))), [*cell, "step"])
    cut = F.floor((F.col("before") + F.pmod(F.xxhash64("id"), F.col("n"))) / BLOCK).cast("int")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows[[*cell, "cut"]].iloc[:1]
        return one.assign(near=rows["angle"].min(), far=rows["angle"].max(), ids=[rows["id"].to_numpy(dtype="<i8").tobytes()], units=[b"".join(rows["unit"])])

    packed = ranked.withColumn("cut", cut).select(*cell, "cut", "id", "angle", "unit").groupBy(*cell, "cut").applyInPandas(pack, "pivot int, asks boolean, answers boolean, cut int, near double, far double, ids binary, units binary")
    return packed.withColumn("block", F.xxhash64(*cell, "cut")).drop("cut"), pivots


class _Bounds:
    """Whether two blocks may hold a pair of vectors at an angle from ``least`` to ``most``."""

    def __init__(self, pivots: np.ndarray, least: float, most: float) -> None:
        self.pivots, self.least, self.most = pivots, least, most

    def meet(self, a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        own = lambda df, c: df[c].to_numpy()
        between = np.arccos(np.clip(self.pivots[own(a, "pivot")] @ self.pivots[own(b, "pivot")].T, -1, 1))
        between[own(a, "pivot")[:, None] == own(b, "pivot")[None, :]] = 0.0
        near, far = own(a, "near")[:, None], own(a, "far")[:, None]
        least = np.maximum(between - far - own(b, "far"), np.maximum(near - between - own(b, "far"), own(b, "near") - between - far))
        most = between + far + own(b, "far")
        wanted = (own(a, "asks")[:, None] & own(b, "answers")) | (own(a, "answers")[:, None] & own(b, "asks"))
        return wanted & (least <= self.most + SLACK) & (most >= self.least - SLACK)


_SUMMARY = ["block", "pivot", "asks", "answers", "near", "far"]


def block_pairs(blocks: DataFrame, bounds: _Bounds) -> DataFrame:
    """(a, b): the pairs of blocks that may hold a wanted pair, each once; a block may meet itself.

    Summaries of blocks, a few numbers each, are packed in chunks that meet by an equi-join on chunk numbers.
    """
    n = -(-blocks.count() // CHUNK) or 1
    chunked = blocks.select(*_SUMMARY).withColumn("chunk", F.pmod("block", F.lit(n)).cast("int"))
    packed = staged(chunked.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(*_SUMMARY))).alias("rows")), "summaries")  # CHUNK rows or so
    left = packed.select(F.explode(F.sequence("chunk", F.lit(n - 1))).alias("other"), "chunk", F.col("rows").alias("x"))
    met = left.join(packed.select(F.col("chunk").alias("other"), F.col("rows").alias("y")), "other").select("chunk", "other", "x", "y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, other, x, y in zip(batch["chunk"], batch["other"], batch["x"], batch["y"]):
                x, y = pd.DataFrame(list(x)), pd.DataFrame(list(y))
                for k in range(0, len(x), 256):
                    part = x.iloc[k : k + 256]
                    i, j = np.nonzero(bounds.meet(part, y))
                    a, b = part["block"].to_numpy()[i], y["block"].to_numpy()[j]
                    once = (a <= b) if chunk == other else np.ones(len(a), dtype=bool)
                    yield pd.DataFrame({"a": a[once], "b": b[once]})

    return met.repartition("chunk", "other").mapInPandas(run, "a long, b long")


def rep_pairs(facts: DataFrame, reps: DataFrame, low: float, high: float, closed: bool = False) -> DataFrame:
    """(a, b, distance) of representatives a < b with low <= distance < high (<= high if ``closed``).

    ``reps`` (rep) may have the columns asks and answers: then only pairs of one that asks and one that answers are
    looked for, so a few new vectors meet a large store without the store meeting itself. Pairs of blocks that can
    hold a wanted pair are dealt in tiles; a task holds the blocks of a tile's left side and lets those of its right
    side pass by.
    """
    if "asks" not in reps.columns:
        reps = reps.select("rep", F.lit(True).alias("asks"), F.lit(True).alias("answers"))
    blocks, pivots = _blocks(facts, reps)
    blocks = staged(blocks, "blocks")
    angle = lambda d: math.acos(min(1.0, max(-1.0, 1.0 - d)))
    bounds = _Bounds(pivots, angle(low), angle(high))
    tiles = -(-blocks.count() // TILE) or 1
    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(tiles)).cast("int")
    pairs = staged(block_pairs(blocks, bounds).select("a", "b", tile("a").alias("ta"), tile("b").alias("tb")), "block pairs")
    turned = F.col("ta") > F.col("tb")
    ordered = pairs.select(*[F.when(turned, y).otherwise(F.col(x)).alias(x) for x, y in (("a", F.col("b")), ("b", F.col("a")), ("ta", F.col("tb")), ("tb", F.col("ta")))])
    side = lambda c, right: ordered.select("ta", "tb", F.col(c).alias("block"), F.lit(right).alias("right")).distinct()
    rows = side("a", False).unionByName(side("b", True)).join(blocks, "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i : i + 1]
                r = row.iloc[0]
                if at != (r["ta"], r["tb"]):
                    at, held = (r["ta"], r["tb"]), []
                ids = np.frombuffer(r["ids"], dtype="<i8")
                units = np.frombuffer(r["units"], dtype="<f8").reshape(len(ids), -1)
                if not r["right"]:
                    held.append((row[_SUMMARY], ids, units))
                    continue
                for own, a, x in held:
                    same = own["block"].iloc[0] == r["block"]
                    if (r["ta"] == r["tb"] and own["block"].iloc[0] > r["block"]) or not bounds.meet(own, row)[0, 0]:
                        continue
                    d = 1.0 - x @ units.T
                    keep = (d >= low - 1e-12) & ((d <= high + 1e-12) if closed else (d < high))
                    if same:
                        keep &= a[:, None] < ids[None, :]
                    j, k = np.nonzero(keep)
                    yield pd.DataFrame({"a": np.minimum(a[j], ids[k]), "b": np.maximum(a[j], ids[k]), "distance": np.maximum(d[j, k], 0.0)})

    dealt = rows.repartition("ta", "tb").sortWithinPartitions("ta", "tb", "right", "block")
    return dealt.select("ta", "tb", "right", *_SUMMARY, "ids", "units").mapInPandas(run, "a long, b long, distance double")


def similar_pairs(facts: DataFrame, threshold: float, method: str = "blocked") -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives (a, b, distance), membership (id, rep)): facts within the threshold without expanding copies.

    ``method="lsh"`` takes candidates from random projections instead: faster, with some pairs missed.
    """
    member = staged(classes(facts), "members")
    reps = member.select("rep").distinct()
    if method == "blocked":
        return rep_pairs(facts, reps, 0.0, threshold), member
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    v = facts.join(reps.select(F.col("rep").alias("id")), "id").select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="unit").transform(v).select("id", "unit")
    radius = math.sqrt(2 * threshold)  # on unit vectors, the squared Euclidean distance is twice the cosine distance
    lsh = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=2 * radius, numHashTables=8, seed=1).fit(unit)
    near = lsh.approxSimilarityJoin(unit, unit, radius, "d").where("datasetA.id < datasetB.id AND d < " + repr(radius))
    return near.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), (F.col("d") * F.col("d") / 2).alias("distance")).distinct(), member


def _ranked(facts: DataFrame, low: float, high: float, k: int, closed: bool) -> DataFrame:
    """(id, neighbor_id, distance, rank): the k nearest others of each fact inside the bounds, by (distance to DIGITS digits, id)."""
    member = staged(classes(facts), "members")
    # of a class no more than k + 1 members can be anybody's neighbours
    first = member.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = staged(rep_pairs(facts, member.select("rep").distinct(), low, high, closed), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    if low <= 0:
        both = both.unionByName(member.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct().withColumn("distance", F.lit(0.0)))
    both = both.withColumn("level", F.round("distance", DIGITS))
    near = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("level", "b"))).where(F.col("r") <= k + 1)
    of_rep = near.join(first, near["b"] == first["rep"]).select("a", "level", "distance", F.explode("ids").alias("neighbor_id"))
    of_rep = of_rep.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("level", "neighbor_id"))).where(F.col("r") <= k + 1)
    lists = of_rep.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("level", "neighbor_id", "distance"))).alias("near"))
    own = member.join(lists, member["rep"] == lists["a"]).select("id", F.posexplode(F.slice(F.filter("near", lambda n: n["neighbor_id"] != F.col("id")), 1, k)).alias("p", "n"))
    return own.select("id", "n.neighbor_id", "n.distance", (F.col("p") + 1).alias("rank"))


def knn_neighbors(facts: DataFrame, threshold: float = 0.15, k: int = 10) -> DataFrame:
    """The k nearest others of each fact closer than the threshold."""
    return _ranked(facts, 0.0, threshold, k, closed=False)


def band_candidates(facts: DataFrame, new: DataFrame, low: float = 0.05, high: float = 0.3, k: int = 10) -> DataFrame:
    """Per new fact the k nearest original facts at a distance from low to high, both included, by (distance to DIGITS digits, id)."""
    pool = facts.where("is_original").select("id", "embedding").unionByName(facts.join(new.select("id"), "id", "left_semi").select("id", "embedding")).distinct()
    member = staged(classes(pool), "members")
    sides = member.join(new.select("id").distinct().withColumn("asks", F.lit(True)), "id", "left").join(facts.where("is_original").select("id").distinct().withColumn("answers", F.lit(True)), "id", "left")
    pairs = staged(rep_pairs(pool, _sides(sides), low, high, closed=True), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    originals = member.join(facts.where("is_original").select("id"), "id", "left_semi")
    first = originals.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k)
    of_rep = both.join(first.select(F.col("rep").alias("b"), F.col("id").alias("neighbor_id")), "b")
    of_rep = of_rep.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.round("distance", DIGITS), "neighbor_id"))).where(F.col("rank") <= k)
    own = member.join(new.select("id"), "id", "left_semi")
    return own.join(of_rep, own["rep"] == of_rep["a"]).select("id", "neighbor_id", "distance", "rank")


def _sides(member: DataFrame) -> DataFrame:
    """(rep, asks, answers) of members (rep, asks, answers): what any member of a class does."""
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False))).alias(c)
    return staged(member.groupBy("rep").agg(any_("asks"), any_("answers")), "sides")


def near_existing(facts: DataFrame, existing: DataFrame, threshold: float) -> DataFrame:
    """(id) of the facts (id, embedding) that lie closer than the threshold to any of ``existing`` (id, embedding)."""
    v = F.col("embedding").cast("array<double>").alias("embedding")
    both = facts.select((F.col("id") * 2).alias("id"), v).unionByName(existing.select((F.col("id") * 2 + 1).alias("id"), v))
    member = staged(classes(both), "members")
    stored = member.where("id % 2 <> 0").select("rep").distinct()
    sides = member.withColumn("asks", F.col("id") % 2 == 0).withColumn("answers", F.col("id") % 2 != 0)
    pairs = staged(rep_pairs(both, _sides(sides), 0.0, threshold).select("a", "b"), "pairs")
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    close = ways.join(stored, ways["b"] == stored["rep"], "left_semi").select(F.col("a").alias("rep")).unionByName(stored).distinct()
    return member.where("id % 2 = 0").join(close, "rep", "left_semi").select((F.col("id") / 2).cast("long").alias("id")).distinct()


def dedup_facts(facts: DataFrame, threshold: float = 0.05, existing: DataFrame | None = None) -> DataFrame:
    """(id, kept): facts in order of (created_at, id); one is kept unless a fact kept before it, or one of ``existing`` (id, embedding), is closer than the threshold.

    Copies of a vector: only the first of them in order can be kept. What one of these firsts does depends on its own
    component of the pair graph only, so a component of up to COMPONENT pairs is settled by one task, fact after fact;
    larger ones are settled in rounds (``_rounds``). Null vectors are kept.
    """
    if existing is not None:
        near = near_existing(facts, existing, threshold)
        rest = dedup_facts(facts.join(near, "id", "left_anti"), threshold)
        return rest.unionByName(near.withColumn("kept", F.lit(False)))
    base = facts.select("id", "created_at", F.col("embedding").cast("array<double>").alias("embedding"))
    member = staged(classes(base), "members")
    order = F.struct("created_at", "id")
    lead = staged(member.join(base.select("id", "created_at"), "id").groupBy("rep").agg(F.min(order).alias("o")), "leads")
    pairs = rep_pairs(base, member.select("rep").distinct(), 0.0, threshold)
    a, b = lead.select(F.col("rep").alias("a"), F.col("o").alias("oa")), lead.select(F.col("rep").alias("b"), F.col("o").alias("ob"))
    first = F.col("oa") < F.col("ob")
    turned = pairs.join(a, "a").join(b, "b").select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("a", "b", "early"), ("b", "a", "late"), ("oa", "ob", "o_early"), ("ob", "oa", "o_late"))])
    directed = staged(turned, "pairs")
    root = connected(directed, "early", "late")
    rooted = staged(directed.join(root, directed["early"] == root["node"]).drop("node"), "pairs")
    large = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMPONENT).select("root")
    large = staged(large, "large")
    flat = [F.col(f"o_{x}.{c}").alias(f"{x}_{c}") for x in ("early", "late") for c in ("created_at", "id")]
    small = rooted.join(large, "root", "left_anti").select("root", "early", "late", *flat)
    settled = small.groupBy("root").applyInPandas(_in_order, "rep long, kept boolean")
    if not large.isEmpty():
        settled = settled.unionByName(_rounds(rooted.join(large, "root", "left_semi").select("early", "late")))
    state = lead.join(settled, "rep", "left").select("rep", F.coalesce("kept", F.lit(True)).alias("kept"), F.col("o.id").alias("lead_id"))
    known = member.join(state, "rep").select("id", (F.col("kept") & (F.col("id") == F.col("lead_id"))).alias("k"))
    return facts.select("id").join(known, "id", "left").select("id", F.coalesce("k", F.lit(True)).alias("kept"))


def _in_order(pairs: pd.DataFrame) -> pd.DataFrame:
    """(rep, kept) of one component's facts, one after the other: dropped if a kept one before it is near."""
    before: dict[int, list[int]] = {}
    for early, late in zip(pairs["early"].tolist(), pairs["late"].tolist()):
        before.setdefault(late, []).append(early)
        before.setdefault(early, [])
    ends = pd.concat([pairs[[side, f"{side}_created_at", f"{side}_id"]].set_axis(["rep", "at", "id"], axis=1) for side in ("early", "late")]).drop_duplicates("rep")
    kept: dict[int, bool] = {}
    for rep in ends.sort_values(["at", "id"], na_position="first")["rep"].tolist():
        kept[rep] = not any(kept[x] for x in before[rep])
    return pd.DataFrame({"rep": list(kept), "kept": list(kept.values())})


def _rounds(directed: DataFrame) -> DataFrame:
    """(rep, kept) of the facts in ``directed`` (early, late): each round settles the facts whose earlier neighbours are all dropped, or of which one is kept."""
    late = directed.select(F.col("late").alias("rep")).distinct()
    early = directed.select(F.col("early").alias("rep")).distinct().join(late, "rep", "left_anti")
    state = staged(late.withColumn("kept", F.lit(None).cast("boolean")).unionByName(early.withColumn("kept", F.lit(True))), "state")
    while not state.where("kept IS NULL").isEmpty():
        seen = directed.join(state.select(F.col("rep").alias("early"), F.col("kept").alias("k")), "early").groupBy("late").agg(F.max(F.coalesce("k", F.lit(False))).alias("any_kept"), F.count_if(F.col("k").isNull()).alias("n_open"))
        state = staged(state.join(seen, state["rep"] == seen["late"], "left").select("rep", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("any_kept"), False).when(F.col("n_open") == 0, True).alias("kept")), "state")
    return state


def cross_candidates(to_check: DataFrame, baseline: DataFrame, most: int = 500) -> DataFrame:
    """(fact1_id, fact2_id): each fact to check against a baseline of at most ``most`` facts."""
    small = baseline.orderBy(F.desc("created_at"), "id").limit(most).select(F.col("id").alias("fact2_id"))
    return to_check.select(F.col("id").alias("fact1_id")).crossJoin(F.broadcast(small)).where("fact1_id <> fact2_id")  # at most ``most`` rows are broadcast
