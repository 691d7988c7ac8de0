"""Deterministic selection: hash order, hash splits, quotas, folds and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from veridex.operators import ranges


def hash_key(salt: str, value: Column) -> Column:
    """A digest that orders rows at random, but the same way each time."""
    return F.sha2(F.concat_ws("::", F.lit(salt), value.cast("string")), 256)


def modulo_of_md5(value: Column, modulus: int) -> Column:
    """The whole 128-bit md5 modulo a small number, folded over its hexadecimal digits."""
    digits = F.transform(F.split(F.md5(value.cast("string")), ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda rest, d: (rest * 16 + d) % modulus)


def held_out(frame: DataFrame, by: str, salt: str, key: str, n: int) -> DataFrame:
    """split: the first n rows of each class, in the order of salted digests, are heldout, the others train.

    A class without n + 1 rows stops the query.
    """
    ranked = ranges.numbered(frame.withColumn("_h", hash_key(salt, F.col(key))), [by], [F.col("_h"), F.col(key)])
    small = F.raise_error(F.concat(F.lit("class too small: "), F.col(by).cast("string")))
    split = F.when(F.col("_n") <= n, small).when(F.col("_rn") <= n, F.lit("heldout")).otherwise(F.lit("train"))
    return ranked.withColumn("split", split).drop("_rn", "_n", "_h")


def folds(frame: DataFrame, by: str, order: str, k: int, strict: bool = False) -> DataFrame:
    """fold: chunks of equal size in each class in the order of a number; rows beyond a multiple of k go to the last folds.

    strict: a class whose size k doesn't divide stops the query.
    """
    ranked = ranges.numbered(frame, [by], [F.col(order)])
    uneven = F.raise_error(F.concat(F.lit("folds don't divide: "), F.col(by).cast("string")))
    fold = F.floor((F.col("_rn") - 1) * k / F.col("_n")).cast("int")
    return ranked.withColumn("fold", F.when(F.lit(strict) & (F.col("_n") % k != 0), uneven.cast("int")).otherwise(fold)).drop("_rn", "_n")


def sentinels(frame: DataFrame, by: str, order: str) -> DataFrame:
    """The first, the middle and the last row of each class in the order of a number."""
    ranked = ranges.numbered(frame, [by], [F.col(order)])
    wanted = (F.col("_rn") == 1) | (F.col("_rn") == F.floor(F.col("_n") / 2) + 1) | (F.col("_rn") == F.col("_n"))
    return ranked.filter(wanted).drop("_rn", "_n")


def repeated(frame: DataFrame, times: Column) -> DataFrame:
    """Each row so many times, numbered by copy from 0."""
    return frame.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))


def balanced(frame: DataFrame, by: str, order: str) -> DataFrame:
    """Classes filled up to the largest by taking their rows in turn again; slot counts from 0."""
    ranked = ranges.numbered(frame, [by], [F.col(order)])
    most = frame.groupBy(by).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c").alias("_most"))  # one row
    turns = F.sequence(F.col("_rn") - 1, F.col("_most") - 1, F.col("_n"))
    return ranked.crossJoin(most).withColumn("slot", F.explode(turns)).drop("_rn", "_n", "_most")


def with_stored_split(rows: DataFrame, manifest: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Rows with the split that a manifest (key, split) has for them; a row that it doesn't name stops the query."""
    missing = F.raise_error(F.concat(F.lit("not in the split manifest: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return rows.join(manifest.select(key, F.col(split).alias("_split")), key, "left").withColumn(split, F.coalesce("_split", missing.cast("string"))).drop("_split")


def without_keys(kind: DataType, value: Column, keys: set[str]) -> Column:
    """A nested value without fields of these names at any depth; arrays and structs are walked by their type."""
    if isinstance(kind, StructType):
        return F.struct(*(without_keys(f.dataType, value[f.name], keys).alias(f.name) for f in kind.fields if f.name not in keys))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: without_keys(kind.elementType, x, keys))
    return value
