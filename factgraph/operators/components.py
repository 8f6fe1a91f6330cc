"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged


def _lowest(both: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least node among u and its neighbours. Sums come before the shuffle, and the join's right side has a node once."""
    return both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", F.least("u", "m").alias("m"))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that an edge of two different nodes has; the root is the component's least node.

    In each round nodes are hung below the least node next to them, first the larger neighbours of every node, then the
    smaller: about log(n) rounds, each over a staged table of edges, until nothing changes.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, state = staged(e, "edges"), None
    while (now := tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != state and now[0]:
        state = now
        larger = _lowest(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        hung = _lowest(larger)
        e = staged(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
