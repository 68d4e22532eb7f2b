"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import discard, written


def _settled(edges: DataFrame) -> bool:
    """Whether each node points at one other at most and none that is pointed at points on: then all edges are stars."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("x")).select("x.*")
    open_ = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("in") == 1)))
    return not open_.take(1)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return ``(id, component)``: each node that has an edge to another node, with the smallest id it can reach.

    Large-star then small-star steps (Kiveris et al., 2014) until all edges are stars around the least ids, O(log^2 n) rounds
    whatever the diameter. Each step groups by a node to find its least neighbour (combined before the shuffle) and joins that
    back; the minima are written first, so that both join sides are plain exchanges and the adaptive skew join can split a hub.
    Nothing but whether a round was the last reaches the driver. Null ends and self-loops are ignored; repeated edges count
    once; an empty table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    e = written(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(e):
            break
        # Large star: every larger neighbour of a node goes to the least of the node and its neighbours.
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: every smaller neighbour of a node, and the node, go to the least of them.
        small_least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(small_least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, e = e, written(small.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before, least, large, small_least)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Every node now points at its component's least id.
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
