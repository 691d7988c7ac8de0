"""Ranks and prefix sums in an order over tables that no task could sort alone.

Rows are dealt out in ranges whose borders Spark samples from the rows themselves, so neither outliers nor common prefixes
fill one task; they are sorted in their range and written, so that all that follows sees the same ranges.  A row's place is
its place in the range and the number of rows of its class in the ranges before, which few counts tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.sources.shared import written

#: Rows of one range keep their order in the lower bits of the number that Spark gives them, the range in the others.
BITS = 33


def in_ranges(frame: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The rows in ranges of (by, order), with _m, which rises along it, and _part, the range."""
    keys = [*map(F.col, by), *order]
    dealt = written(frame.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    return dealt.withColumn("_part", F.shiftright("_m", BITS))


def _matched(by: list[str]) -> Column:
    same = F.col("_part") == F.col("_p")
    for i, name in enumerate(by):
        same = same & F.col(name).eqNullSafe(F.col(f"_by{i}"))
    return same


def _offsets(dealt: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """(_p, _by…, _first, name before, name total) of each class in each range; a range has a row for each class it holds."""
    held = dealt.groupBy("_part", *by).agg(F.min("_m").alias("_first"), *(value.alias(f"_{name}") for name, value in sums.items()))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    out = held.select("*", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_before") for n in sums), *(F.sum(f"_{n}").over(whole).alias(f"_{n}_total") for n in sums))
    return out.drop(*(f"_{n}" for n in sums)).withColumnsRenamed({"_part": "_p", **{name: f"_by{i}" for i, name in enumerate(by)}})


def numbered(frame: DataFrame, by: list[str], order: list[Column], name: str = "_rn", total: str = "_n") -> DataFrame:
    """Row numbers from 1 in each class in an order, and the class's size.

    A null class is a class; nulls of the order stand where it puts them; rows that tie in it are numbered in some order.
    """
    dealt = in_ranges(frame, by, order)
    starts = _offsets(dealt, by, {"rows": F.count(F.lit(1))})
    placed = dealt.join(starts, _matched(by))
    out = placed.withColumn(name, F.col("_rows_before") + F.col("_m") - F.col("_first") + 1).withColumn(total, F.col("_rows_total"))
    return out.select(*frame.columns, name, total)


def running(frame: DataFrame, by: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """Adds, for each of some columns, <name>_up_to, its sum over the class's rows up to this one, and <name>_total."""
    dealt = in_ranges(frame, by, order)
    starts = _offsets(dealt, by, {name: F.coalesce(F.sum(name), F.lit(0)) for name in values})
    own = Window.partitionBy("_part", *by).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.select("*", *(F.coalesce(F.sum(name).over(own), F.lit(0)).alias(f"_{name}_own") for name in values)).join(starts, _matched(by))
    sums = {f"{name}_up_to": F.col(f"_{name}_before") + F.col(f"_{name}_own") for name in values}
    totals = {f"{name}_total": F.col(f"_{name}_total") for name in values}
    return placed.withColumns(sums | totals).select(*frame.columns, *sums, *totals)


def medians(frame: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """(by…, name): the exact median of a number in each class, the mean of the middle two where their count is even.

    Nulls don't count; a class of nothing else has a null.
    """
    held = frame.select(*by, F.col(value).cast("double").alias("_v"))
    counted = held.filter("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    summed = running(counted, by, [F.col("_v")], ["_c"])
    below = F.col("_c_up_to") - F.col("_c")
    middle = [F.floor((F.col("_c_total") - 1) / 2), F.floor(F.col("_c_total") / 2)]  # counted from 0
    hit = [(below <= at) & (at < F.col("_c_up_to")) for at in middle]
    found = summed.filter(hit[0] | hit[1]).groupBy(*by).agg(((F.min("_v") + F.max("_v")) / 2).alias(name))
    classes = frame.select(*by).distinct() if by else None
    if classes is None:
        return found
    same = [F.col(f"_k{i}").eqNullSafe(F.col(b)) for i, b in enumerate(by)]
    keyed = classes.select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)))
    return keyed.join(found, same, "left").select(*(F.col(f"_k{i}").alias(b) for i, b in enumerate(by)), name)
