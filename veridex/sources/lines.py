"""Lines of text files with their numbers, however Spark splits the files, and errors that name path and line.

A block of a file holds the lines that start in it.  A row a block, with its number of lines, tells how many lines are before
it; within a block lines keep their order.  Only rows that are asked for meet that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    block = F.col("_metadata.file_block_start")
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), block.alias("_block"), F.monotonically_increasing_id().alias("_m"))


def numbered_lines(spark: SparkSession, path: str | list[str], wanted: Column | None = None) -> DataFrame:
    """(path, line, value) of the lines of text files that a condition on value holds for, numbered from 1 in each file."""
    lines = _read(spark, path)
    blocks = lines.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select(F.col("path").alias("_p"), F.col("_block").alias("_b"), (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("_shift"))
    rows = lines if wanted is None else lines.filter(wanted)
    placed = rows.join(starts, (F.col("path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return placed.select("path", (F.col("_m") + F.col("_shift")).alias("line"), "value")


def _parsed(schema: str) -> Column:
    return F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})


def malformed_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(path, line, value) of the lines that aren't one JSON record of the schema; blank lines are none."""
    return numbered_lines(spark, path, (F.trim("value") != "") & _parsed(schema)["_corrupt"].isNotNull())


def checked_json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One record a line, blank lines skipped; the first malformed line, by path, stops the read with its path and number."""
    bad = malformed_lines(spark, path, schema).agg(F.min(F.struct("path", "line")).alias("at")).first()["at"]
    if bad is not None:
        raise ValueError(f"malformed record at {bad['path']}:{bad['line']}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
