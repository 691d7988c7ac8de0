"""A release folder held against its manifest: paths, digests and numbers of records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a manifest has a row for; columns that it lacks are null.
FIELDS = {"path": "string", "kind": "string", "records": "bigint", "sha256": "string", "required": "boolean", "safe_to_publish": "boolean"}
DIGEST = "^[0-9a-f]{64}$"


def relative_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, path, content) of all files below a folder; path is relative to it.  content is read only where it is used."""
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return whole.select(F.col("path").alias("file"), _below(F.col("path"), root).alias("path"), "content")


def _below(path: Column, root: str) -> Column:
    """What comes after the folder in the path of a file below it."""
    bare = root.split("://", 1)[-1].removeprefix("file:").strip("/")
    return F.regexp_replace(path, f"^.*?/{re.escape(bare)}/", "")


def path_issue(path: Column) -> Column:
    """What is wrong with a path that should be relative and stay inside: the first rule that it breaks, or null."""
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "path_empty")
        .when(path != F.trim(path), "path_with_outer_blanks")
        .when(path.contains("\\"), "path_with_backslash")
        .when(path.startswith("/"), "path_absolute")
        .when(F.array_contains(F.split(path, "/"), ".."), "path_leaves_folder")
    )


def release_issues(spark: SparkSession, root: str, manifest: DataFrame, prohibited: dict[str, str] | None = None) -> DataFrame:
    """(path, issue, expected, found): all breaches of a manifest; no rows for a release that keeps it.

    A path names a file, or a folder whose records are those of the files below it.  prohibited: patterns by name that a
    path with its kind may not match.  A null required counts as true.  Files that no path covers are surplus.
    """
    rows = manifest.select(*(F.col(name).cast(kind).alias(name) if name in manifest.columns else F.lit(None).cast(kind).alias(name) for name, kind in FIELDS.items()))
    rows = rows.withColumn("bad", path_issue(F.col("path")))
    files = relative_files(spark, root)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))

    sound = rows.filter("bad IS NULL")
    listed = files.select("path").withColumn("entry", F.explode(above)).select("entry", "path")
    present = listed.select(F.col("entry").alias("path")).distinct().withColumn("held", F.lit(True))
    wanted_lines = sound.filter("records IS NOT NULL").select("path").distinct()
    lines = spark.read.option("recursiveFileLookup", True).text(root).filter("trim(value) <> ''").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    counts = lines.withColumn("path", _below(F.col("file"), root)).withColumn("path", F.explode(above))
    counts = counts.groupBy("path").agg(F.sum("n").alias("n")).join(wanted_lines, "path", "left_semi")
    wanted_digests = sound.filter("sha256 IS NOT NULL").select("path").distinct()
    digests = files.join(wanted_digests, "path", "left_semi").select("path", F.sha2("content", 256).alias("digest"))

    joined = sound.join(present, "path", "left").join(counts, "path", "left").join(digests, "path", "left")
    absent = F.col("held").isNull()
    none = F.lit(None).cast("string")

    def issue(condition: Column, name: str | Column, expected: Column = none, found: Column = none) -> Column:
        name = F.lit(name) if isinstance(name, str) else name
        return F.when(condition, F.struct(name.alias("issue"), expected.cast("string").alias("expected"), found.cast("string").alias("found")))

    label = F.concat_ws(" ", "path", "kind")
    banned = [issue(label.rlike(pattern), f"prohibited_{name}") for name, pattern in sorted((prohibited or {}).items())]
    checks = [
        issue(F.coalesce(F.trim("kind"), F.lit("")) == "", "kind_missing"),
        issue(~F.coalesce("safe_to_publish", F.lit(False)), "not_marked_safe"),
        issue(F.col("sha256").isNull(), "digest_missing"),
        issue(~F.col("sha256").rlike(DIGEST), "digest_invalid"),
        F.coalesce(*banned) if banned else issue(F.lit(False), ""),
        issue(absent & F.coalesce("required", F.lit(True)), "file_missing"),
        issue(~absent & F.col("records").isNotNull() & (F.coalesce("n", F.lit(0)) != F.col("records")), "records_differ", F.col("records"), F.coalesce("n", F.lit(0))),
        issue(F.col("sha256").rlike(DIGEST) & (F.col("digest") != F.col("sha256")), "digest_differs", F.col("sha256"), F.col("digest")),
    ]
    found = joined.select("path", F.inline(F.filter(F.array(*checks), lambda x: x.isNotNull())))
    broken = rows.filter("bad IS NOT NULL").select("path", F.col("bad").alias("issue"), none.alias("expected"), none.alias("found"))
    repeated = sound.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path", F.lit("path_repeated").alias("issue"), F.lit("1").alias("expected"), F.col("n").cast("string").alias("found"))
    covered = listed.join(sound.select(F.col("path").alias("entry")), "entry", "left_semi").select("path")
    surplus = files.select("path").join(covered, "path", "left_anti").select("path", F.lit("file_surplus").alias("issue"), none.alias("expected"), none.alias("found"))
    return found.unionByName(broken).unionByName(repeated).unionByName(surplus)
