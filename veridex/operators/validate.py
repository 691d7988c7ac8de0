"""Constraint checks that return issues as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(frame: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, issue) for each rule that a row breaks; a rule that is null is broken."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)))
    return frame.select(key, F.explode(found).alias("issue"))


def duplicates(frame: DataFrame, key: str) -> DataFrame:
    """Keys that come more than once."""
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def leaks(frame: DataFrame, visible: Column, hidden: Column) -> DataFrame:
    """Rows whose visible part holds the hidden value, letters of either case alike."""
    return frame.filter(F.contains(F.lower(F.to_json(visible)), F.lower(hidden)))


def least_counts(frame: DataFrame, by: str, least: dict[str, int]) -> DataFrame:
    """Classes below their least count; a class without rows counts 0."""
    spark = frame.sparkSession
    wanted = spark.createDataFrame(sorted(least.items()), f"{by} string, least bigint")
    counted = frame.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(wanted).join(counted, by, "left").select(by, "least", F.coalesce("n", F.lit(0)).alias("n")).filter("n < least")


def reconciled(computed: DataFrame, declared: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose declared value differs from the computed one, absent ones included."""
    both = computed.select(key, F.col(value).alias("computed")).join(declared.select(key, F.col(value).alias("declared")), key, "full_outer")
    return both.filter(~F.col("computed").eqNullSafe(F.col("declared")))
