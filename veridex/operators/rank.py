"""Ranks, top rows of groups, gaps and distinct-on, all with stated tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.operators import ranges


def numbered(frame: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """Row numbers from 1 in each group."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per_group(frame: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return numbered(frame, by, order, "_rn").filter(F.col("_rn") <= n).drop("_rn")


def top_with_ties(frame: DataFrame, by: list[str], score: Column, tie: list[Column]) -> DataFrame:
    """The row of the highest score in each group, the first by tie, and how many rows share its score.

    Aggregates alone: rows are counted by group and score before the best score is taken, so no group is sorted.
    """
    scored = frame.withColumn("_s", F.struct(score.isNotNull().alias("held"), score.alias("value")))
    per_score = scored.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("tie_count"), F.min_by(F.struct(*frame.columns), F.struct(*tie)).alias("_row"))
    best = per_score.groupBy(*by).agg(F.max_by(F.struct("tie_count", "_row"), "_s").alias("_t"))
    return best.select("_t._row.*", F.col("_t.tie_count").alias("tie_count"))


def gaps(frame: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """The best row of each group and its lead over the second, rounded to six places; null for a single row."""
    window = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    ranked = frame.withColumn("_next", F.lead(score).over(window)).withColumn("_rn", F.row_number().over(window))
    return ranked.filter("_rn = 1").withColumn("gap", F.round(F.col(score) - F.col("_next"), 6)).drop("_next", "_rn")


def distinct_on(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_per_group(frame, keys, order, 1)


def middle_of_group(frame: DataFrame, by: str, value: str, least: int = 3) -> DataFrame:
    """The middle of the sorted distinct texts of each group with at least so many."""
    ranked = ranges.numbered(frame.select(by, value).distinct(), [by], [F.col(value)], "_rn", "n_values")
    return ranked.filter((F.col("n_values") >= least) & (F.col("_rn") == F.floor(F.col("n_values") / 2) + 1)).drop("_rn")


def interleaved(frame: DataFrame, by: str, order: str, classes: list[str]) -> DataFrame:
    """Round robin over classes in the order of a number, as long as the smallest class; position counts from 0."""
    counted = ranges.numbered(frame, [by], [F.col(order)])
    sizes = frame.groupBy(by).agg(F.count(F.lit(1)).alias("_m")).agg(F.min("_m").alias("_least"))  # one row
    slot = F.array_position(F.array(*map(F.lit, classes)), F.col(by)) - 1
    kept = counted.crossJoin(sizes).filter(F.col("_rn") <= F.col("_least"))
    return kept.withColumn("position", (F.col("_rn") - 1) * len(classes) + slot).drop("_rn", "_n", "_least")
