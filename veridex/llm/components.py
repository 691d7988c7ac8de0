"""Connected components by alternating large-star and small-star steps, all of them joins and partial minima.

A star's hub has as many edges as the star has nodes.  The minima are written before they are joined to the edges: Spark
splits a hot key only in a join whose two sides are both dealt out for it, which a side still being summed isn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.shared_store import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them; edges run from larger to smaller here."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(u, v): each node with an edge, but for the smallest of its component, and that smallest node.

    edges: columns u and v, of one orderable type, without nulls; direction, repeats and loops don't matter.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        edges = written(_small_star(_large_star(edges)))
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == mark:
            return edges
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
