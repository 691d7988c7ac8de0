"""Risk and coverage over thresholds, certificates and gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sweep(observations: DataFrame, score: str, failed: str, thresholds: list[float]) -> DataFrame:
    """(threshold, targets, trusted, failures): trusted rows have at least the score of the threshold.

    Each row is counted once, at the highest threshold that it passes, and the few counts are added up from above.
    """
    spark = observations.sparkSession
    grid = spark.createDataFrame([(float(t),) for t in sorted(set(thresholds))], "threshold double")
    passed = F.lit(None).cast("double")
    for mark in sorted({float(t) for t in thresholds}):  # the highest is tried first, and compiled, not interpreted
        passed = F.when(F.col(score) >= mark, mark).otherwise(passed)
    binned = observations.groupBy(passed.alias("threshold")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(failed).cast("bigint")).alias("_f"))
    above = Window.orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = observations.agg(F.count(F.lit(1)).alias("targets"))
    joined = F.broadcast(grid).join(binned, "threshold", "left").crossJoin(F.broadcast(total))
    return joined.select(
        "threshold", "targets", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("trusted"), F.coalesce(F.sum("_f").over(above), F.lit(0)).alias("failures")
    )


def hoeffding(swept: DataFrame, delta: float, grid: int) -> DataFrame:
    """Adds failure_rate, coverage and the upper bound over a grid of thresholds; null bounds where nothing is trusted."""
    rate = F.col("failures") / F.nullif(F.col("trusted"), F.lit(0))
    slack = F.sqrt(F.lit(math.log(grid / delta)) / (2 * F.nullif(F.col("trusted"), F.lit(0))))
    return swept.withColumns({"failure_rate": rate, "coverage": F.col("trusted") / F.nullif(F.col("targets"), F.lit(0)), "bound": F.when(F.col("trusted") > 0, F.least(F.lit(1.0), rate + slack))})


def certified(bounded: DataFrame, alpha: float) -> DataFrame:
    """The threshold with the most trusted rows, then the lowest, among those whose bound is at most alpha."""
    return bounded.filter(F.col("bound") <= alpha).orderBy(F.col("trusted").desc(), "threshold").limit(1)


def closest(bounded: DataFrame) -> DataFrame:
    """The threshold with the least bound, then the most trusted rows, then the lowest, whether or not it is certified."""
    return bounded.filter("bound IS NOT NULL").orderBy("bound", F.col("trusted").desc(), "threshold").limit(1)


def least_zero_failure_n(alpha: float, delta: float, grid: int) -> int:
    """The number of trusted rows without a failure that a certificate takes."""
    return math.ceil(math.log(grid / delta) / (2 * alpha * alpha))


def gate_counts(rows: DataFrame, gap: str, correct: str, threshold: Column) -> list[Column]:
    """Aggregates of a gate that trusts rows whose gap reaches the threshold."""
    trusted = F.coalesce(F.col(gap) >= threshold, F.lit(False))
    right = F.col(correct)
    return [
        F.sum(trusted.cast("bigint")).alias("trusted"),
        F.sum((trusted & right).cast("bigint")).alias("correct_trusted"),
        F.sum((trusted & ~right).cast("bigint")).alias("unsafe"),
        F.sum((~trusted).cast("bigint")).alias("fail_closed"),
    ]


def zero_unsafe_threshold(rows: DataFrame, gap: str, correct: str) -> DataFrame:
    """The least threshold that trusts no wrong row: just above the largest gap of one."""
    return rows.agg((F.coalesce(F.max(F.when(~F.col(correct), F.col(gap))), F.lit(0.0)) + 1e-6).alias("threshold"))
