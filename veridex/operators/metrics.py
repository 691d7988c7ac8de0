"""Summaries of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.operators import ranges


def accuracy_by(frame: DataFrame, by: list[str], correct: Column) -> DataFrame:
    """correct, total and the text correct/total of each group."""
    counted = frame.groupBy(*by).agg(F.sum(correct.cast("bigint")).alias("correct"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("fraction", F.concat_ws("/", "correct", "total"))


def merged_fractions(frame: DataFrame, by: list[str], fraction: str) -> DataFrame:
    """Sums of k/n texts."""
    parts = F.split(fraction, "/")
    summed = frame.groupBy(*by).agg(F.sum(parts[0].cast("bigint")).alias("correct"), F.sum(parts[1].cast("bigint")).alias("total"))
    return summed.withColumn("fraction", F.concat_ws("/", "correct", "total"))


def confusion(frame: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts of each pair of classes."""
    return frame.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))


def outcomes(frame: DataFrame, before: Column, after: Column) -> DataFrame:
    """How many rows were kept, rescued, introduced as errors, or stay wrong."""
    label = F.when(before & after, "kept").when(after, "rescued").when(before, "introduced").otherwise("still_wrong")
    return frame.groupBy(label.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def mcnemar(frame: DataFrame, before: Column, after: Column) -> DataFrame:
    """Discordant counts, and chi-squared with continuity correction (0 without discordant pairs)."""
    counted = frame.agg(F.sum((before & ~after).cast("bigint")).alias("b"), F.sum((~before & after).cast("bigint")).alias("c"))
    top = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0))
    return counted.withColumn("chi2", F.coalesce(F.try_divide(top * top, F.col("b") + F.col("c")), F.lit(0.0)).cast("double"))


def wald(frame: DataFrame, correct: Column, z: float = 1.96) -> DataFrame:
    """(n, p, low, high): the share of correct rows and its Wald interval within [0, 1]; null without rows."""
    counted = frame.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(correct, F.lit(False)).cast("double")).alias("p"))
    half = z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return counted.withColumns({"low": F.greatest(F.lit(0.0), F.col("p") - half), "high": F.least(F.lit(1.0), F.col("p") + half)})


def margins(frame: DataFrame, by: list[str], margin: str) -> DataFrame:
    """Count, mean, extremes and exact median of a margin."""
    stats = frame.groupBy(*by).agg(F.count(margin).alias("n"), F.avg(margin).alias("mean"), F.min(margin).alias("least"), F.max(margin).alias("most"))
    middle = ranges.medians(frame, by, margin).withColumnsRenamed({name: f"_{name}" for name in by})
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in by]
    return stats.join(middle, same).drop(*(f"_{name}" for name in by))


def majority(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of those that tie, with its share."""
    counted = frame.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    grouped = counted.groupBy(*by).agg(F.max("n").alias("n"), F.sum("n").alias("total"))
    tied = counted.join(grouped, [*by, "n"]).groupBy(*by, "n", "total").agg(F.min(value).alias(value))
    return tied.withColumn("share", F.col("n") / F.col("total"))
