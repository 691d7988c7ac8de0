"""Greedy selection across several keys: rows in order, each kept unless one of its keys was kept before.

A row that comes first among the undecided rows of all its keys is kept.  A row that is second for one key and first for all
others depends on one row alone: it is kept if that one isn't.  Such rows form chains, and pointers along a chain are
doubled, so a chain of n rows takes log n joins and not n passes.  Only the first two rows of each key are looked at, which
each task finds among its own rows before anything moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.operators import rank
from veridex.sources.shared import written


def _resolved(chains: DataFrame, free: DataFrame) -> DataFrame:
    """(_id, kept) of the rows whose chain ends at a row that is kept.  chains: _id, up (the row it depends on)."""
    steps = written(chains.select("_id", "up", F.lit(True).alias("odd")))
    while True:
        above = steps.select(F.col("_id").alias("b"), F.col("up").alias("above"), F.col("odd").alias("more"))
        joined = steps.join(above, F.col("up") == F.col("b"), "left")
        moved = joined.select(
            "_id", F.coalesce("above", "up").alias("up"), F.when(F.col("more").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("more")).alias("odd"), F.col("b").isNotNull().alias("jumped")
        )
        steps = written(moved)
        if steps.filter("jumped").isEmpty():
            return steps.join(free.select(F.col("_id").alias("f")), F.col("up") == F.col("f")).select("_id", (~F.col("odd")).alias("kept"))


def greedy_unique(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that a loop over them in order would keep: those none of whose keys a kept row has.

    order tells rows apart.  A null key excludes nothing.
    """
    left, kept = written(frame.withColumn("_id", F.monotonically_increasing_id())), None
    while True:
        marked = left.select("_id", *keys)
        for i, key in enumerate(keys):
            first = rank.numbered(left.filter(F.col(key).isNotNull()).select("_id", key, *(c for c in order if c != key)), [key], [F.col(c) for c in order], "_r").filter("_r <= 2")
            heads = first.groupBy(key).agg(F.min_by("_id", "_r").alias("head"), F.max_by("_id", "_r").alias("second"))
            marked = marked.join(heads.select(F.col(key).alias("_k"), F.col("head").alias(f"_h{i}"), F.col("second").alias(f"_s{i}")), F.col(key) == F.col("_k"), "left").drop("_k")
        heading = [F.col(key).isNull() | (F.col(f"_h{i}") == F.col("_id")) for i, key in enumerate(keys)]
        following = [~own & (F.col(f"_s{i}") == F.col("_id")) for i, own in enumerate(heading)]
        ahead = sum(own.cast("int") for own in heading)
        one = reduce(lambda a, b: a | b, following) & (ahead == len(keys) - 1)
        up = F.coalesce(*(F.when(own, F.col(f"_h{i}")) for i, own in enumerate(following)))
        state = F.when(ahead == len(keys), "free").when(one, "chain")
        marked = written(marked.select("_id", state.alias("state"), F.when(one, up).alias("up")).filter("state IS NOT NULL"))

        free = marked.filter("state = 'free'")
        new = free.select("_id")
        chains = marked.filter("state = 'chain'").select("_id", "up")
        if not chains.isEmpty():
            new = new.union(_resolved(chains, free).filter("kept").select("_id"))
        chosen = written(left.join(new.withColumnRenamed("_id", "_n"), F.col("_id") == F.col("_n")).drop("_n"))
        kept = chosen if kept is None else kept.unionByName(chosen)
        left = left.join(chosen.select(F.col("_id").alias("_n")), F.col("_id") == F.col("_n"), "left_anti")
        for key in keys:
            left = left.join(chosen.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
        left = written(left)
        if left.isEmpty():
            return kept.drop("_id")
