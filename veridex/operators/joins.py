"""Joins that report what did not match, exclude what was used, and walk hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.sources.shared import written

#: Rows of one key that a task pairs with all rows of that key at most, and tasks that pairs are dealt to at least.
SIBLING_BLOCK = 1024
SIBLING_TASKS = 192


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join with a join_status of matched, missing (no right row) or unexpected (no left row)."""
    one = left.withColumn("_in_left", F.lit(True))
    two = right.withColumn("_in_right", F.lit(True))
    status = F.when(F.col("_in_right").isNull(), "missing").when(F.col("_in_left").isNull(), "unexpected").otherwise("matched")
    return one.join(two, key, "full_outer").withColumn("join_status", status).drop("_in_left", "_in_right")


def strict_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that stops the query if a key repeats on a side or is missing on one."""
    counted = aligned(
        left.groupBy(key).agg(F.count(F.lit(1)).alias("_l")), right.groupBy(key).agg(F.count(F.lit(1)).alias("_r")), key
    ).filter("NOT (_l <=> 1 AND _r <=> 1)")
    bad = counted.select(F.raise_error(F.concat(F.lit("not one row on either side: "), F.col(key).cast("string"))).cast("boolean").alias("_bad"))
    return left.join(right, key).join(bad.limit(1), F.col("_bad"), "left_anti")


def with_status(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with join_status joined or no_match."""
    marked = right.withColumn("_hit", F.lit(True))
    return left.join(marked, key, "left").withColumn("join_status", F.when(F.col("_hit"), "joined").otherwise("no_match")).drop("_hit")


def exclude_used(candidates: DataFrame, used: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows none of whose keys was used: one anti-join a key."""
    for frame, key in used:
        candidates = candidates.join(frame.select(key).distinct(), key, "left_anti")
    return candidates


def ladder(queries: DataFrame, key: str, tiers: list[tuple[str, DataFrame, Column]], value: str) -> DataFrame:
    """Resolution by tiers: each tier sees only the rows that earlier tiers left; what is left abstains.

    tiers: (name, table with columns match and value, expression of the query that must equal match).
    """
    found, rest = None, queries
    for name, table, lookup in tiers:
        hit = rest.withColumn("_look", lookup).join(table, F.col("_look") == F.col("match")).select(key, F.col(value), F.lit(name).alias("source"))
        found = hit if found is None else found.unionByName(hit)
        rest = rest.join(hit.select(key), key, "left_anti")
    return found.unionByName(rest.select(key, F.lit(None).cast("string").alias(value), F.lit("abstain").alias("source")))


def ground_set(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, other, relation) of each node with itself (EXACT), its descendants of depth 1 and 2 (SUBTYPE) and its parents
    (ANCESTOR); of several relations the first in this order.  nodes: node; edges: child, parent."""
    one = edges.select(F.col("parent").alias("node"), F.col("child").alias("other"))
    two = one.join(one.toDF("above", "below"), F.col("other") == F.col("above")).select("node", F.col("below").alias("other"))
    parts = [nodes.select("node", F.col("node").alias("other")), one.join(nodes, "node", "left_semi"), two.join(nodes, "node", "left_semi")]
    parts.append(edges.select(F.col("child").alias("node"), F.col("parent").alias("other")).join(nodes, "node", "left_semi"))
    every = None
    for rank, (part, relation) in enumerate(zip(parts, ["EXACT", "SUBTYPE", "SUBTYPE", "ANCESTOR"], strict=True)):
        tagged = part.select("node", "other", F.struct(F.lit(rank).alias("rank"), F.lit(relation).alias("relation")).alias("tag"))
        every = tagged if every is None else every.unionByName(tagged)
    return every.groupBy("node", "other").agg(F.min("tag").alias("tag")).select("node", "other", F.col("tag.relation").alias("relation"))


def neighbourhood(edges: DataFrame) -> DataFrame:
    """(node, neighbour) of each node of an edge with itself, its parents, its children and the children of its parents."""
    up, down = edges.toDF("node", "neighbour"), edges.select(F.col("parent").alias("node"), F.col("child").alias("neighbour"))
    siblings = edges.toDF("node", "over").join(edges.toDF("neighbour", "over"), "over").select("node", "neighbour")
    own = up.select("node").union(down.select("node")).select("node", F.col("node").alias("neighbour"))
    return up.union(down).union(siblings).union(own).distinct()


def siblings(rows: DataFrame, keys: list[str], id_col: str, block: int = SIBLING_BLOCK) -> DataFrame:
    """(one, other), distinct: ids of different rows that share all keys; null keys and ids pair with none.

    The result grows with the square of a key's rows, so nothing but the rows themselves goes through a shuffle: those of a
    key are cut into blocks, each block meets all of them, and pairs are passed on as they come.  A pair can come twice
    only where both ids have several keys; those pairs alone are made distinct.
    """
    held = rows.select(*keys, F.col(id_col).alias("_id")).dropna().distinct()
    sizes = held.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).alias("_parts"))
    several = held.groupBy("_id").agg((F.count(F.lit(1)) > 1).alias("_several"))
    held = written(held.join(sizes, keys).join(several, "_id"))
    tasks = max(SIBLING_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def paired(frame: DataFrame) -> DataFrame:
        on = [*keys, "_part"]
        one = frame.withColumn("_part", F.pmod(F.xxhash64("_id"), "_parts")).drop("_parts").withColumnsRenamed({"_id": "one", "_several": "_one"})
        other = frame.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts").withColumnsRenamed({"_id": "other", "_several": "_other"})
        return one.repartition(tasks, *on).hint("merge").join(other.repartition(tasks, *on), on).filter(F.col("one") != F.col("other"))

    once = paired(held).filter(~(F.col("_one") & F.col("_other"))).select("one", "other")
    return once.unionAll(paired(held.filter("_several")).select("one", "other").distinct())
