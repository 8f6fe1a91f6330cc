"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least node among u and its neighbours; sums before the shuffle and a plain join, so a hub's edges may be split."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low, "u").select("u", "v", F.least("u", "m").alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in ``edges``; the root is the component's least node.

    Alternates large-star and small-star rounds, each a sum and a join over a staged edge table, until the edges no
    longer change: about log(n) rounds. Edges with a null end are left out; loops and repeated edges do no harm.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    loops = common.staged(e.where("u = v").select("u", "v").distinct(), "loops")
    e = common.staged(e.where("u > v").distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        small = _least(large)
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        e = common.staged(stars, "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    known = stars.unionByName(roots)
    alone = loops.join(known, loops["u"] == known["node"], "left_anti").select(F.col("u").alias("node"), F.col("u").alias("root"))
    return known.unionByName(alone)
