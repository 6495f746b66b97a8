"""Connected components of a large edge list, by alternating stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Pairs (16 bytes each) that one task may get for one node; nodes of more are broadcast.
HOT = 100_000


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of ``edges(x, y)`` has one smaller neighbour at most, which has none itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.lit(1).alias("up")), F.struct(F.col("y").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    wrong = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)")
    return wrong.agg(F.count(F.lit(1))).first()[0] == 0


def _with_least(pairs: DataFrame, rows: int) -> DataFrame:
    """``x, y, m`` for the ``rows`` of ``pairs(x, y)``, ``m`` the least ``y`` of each ``x``. Nodes of many pairs get it by broadcast, where the pairs lie."""
    least = pairs.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("_n"))
    if rows <= HOT:
        return pairs.join(least.drop("_n"), "x")
    least = materialize(least, "least")
    many = F.col("_n") > max(HOT, rows // 100_000)  # so below 100,000 nodes
    hot, cold = F.broadcast(least.where(many).drop("_n")), least.where(~many).drop("_n")
    if hot.isEmpty():
        return pairs.join(cold, "x")
    return pairs.join(hot, "x").unionByName(pairs.join(hot, "x", "left_anti").join(cold, "x"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges(a, b)``; the component is its smallest node.

    Each round joins every node's larger neighbours to its smallest one, then its smaller neighbours likewise, until
    every node hangs on its component's smallest: about log(n) rounds. Smallest neighbours are found with map-side
    aggregation; the pairs of a node that has many stay where they are.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()
    now = materialize(now, "edges")
    while not _are_stars(now):
        count = now.count()
        both = now.union(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = _with_least(both, 2 * count).select("x", "y", F.least("x", "m").alias("m"))
        large = least.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = materialize(large, "large") if count > HOT else large
        low = _with_least(large, count)
        small = low.select(F.explode(F.array(F.struct(F.col("x"), F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*")
        now = materialize(small.where("x != y").distinct(), "edges")
    return now.select(F.col("x").alias("node"), F.col("y").alias("component")).union(now.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
