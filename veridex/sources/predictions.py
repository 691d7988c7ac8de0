"""A folder of predictions held against its contract: the files of each job, its ranking table and its summaries.

A job has a folder of its name with fixed files, and a folder for each sample, told apart by seed and number.  The contract
is a table of (job, seed, sample); all jobs are checked together, by joins of what is there with what should be.  Folders
without a file and links are not seen, as Spark lists files alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.sources.lines import numbered_lines
from veridex.sources.release import relative_files

#: Files of a job and of a sample, after the job's or the sample's name; the ranking table and its range.
JOB_FILES = ["_model.cif", "_confidences.json", "_summary_confidences.json", "_data.json", "_ranking_scores.csv"]
PLAIN_FILES = ["TERMS_OF_USE.md"]
SAMPLE_FILES = ["_model.cif", "_confidences.json", "_summary_confidences.json"]
HEADER = "seed,sample,ranking_score"
LOW, HIGH, TOLERANCE = -100.0, 1.5, 0.005001


def _output() -> Column:
    return F.format_string("seed-%d_sample-%d", "seed", "sample")


def expected_files(contract: DataFrame) -> DataFrame:
    """(job, path) of all files that a contract of (job, seed, sample) asks for."""
    top = F.array(*(F.concat("job", F.lit(name)) for name in JOB_FILES), *map(F.lit, PLAIN_FILES))
    jobs = contract.select("job").distinct().select("job", F.explode(top).alias("name")).select("job", F.concat_ws("/", "job", "name").alias("path"))
    own = F.array(*(F.concat("job", F.lit("_"), _output(), F.lit(name)) for name in SAMPLE_FILES))
    samples = contract.select("job", _output().alias("output"), F.explode(own).alias("name"))
    return jobs.union(samples.select("job", F.concat_ws("/", "job", "output", "name").alias("path")))


def file_issues(spark: SparkSession, root: str, contract: DataFrame) -> DataFrame:
    """(job, issue, detail): files that are missing or surplus, by their paths."""
    there = relative_files(spark, root).select(F.substring_index("path", "/", 1).alias("job"), "path")
    wanted = expected_files(contract)
    missing = wanted.join(there, "path", "left_anti").select("job", F.lit("file_missing").alias("issue"), F.col("path").alias("detail"))
    return missing.union(there.join(wanted, "path", "left_anti").select("job", F.lit("file_surplus"), "path"))


def _job_of(path: str, up: int) -> Column:
    return F.element_at(F.split(path, "/"), -up)


def ranking_lines(spark: SparkSession, root: str) -> DataFrame:
    """(job, line, value) of all ranking tables."""
    lines = numbered_lines(spark, f"{root}/*/*_ranking_scores.csv")
    return lines.select(_job_of("path", 2).alias("job"), "line", F.rtrim("value").alias("value"))


def rankings(spark: SparkSession, root: str) -> DataFrame:
    """(job, seed, sample, ranking_score) of all ranking tables; what doesn't parse is null."""
    parts = F.split("value", ",")
    rows = ranking_lines(spark, root).filter("line > 1 AND value <> ''")
    cast = lambda i, kind: F.get(parts, F.lit(i)).try_cast(kind)
    return rows.select("job", "line", F.size(parts).alias("fields"), cast(0, "bigint").alias("seed"), cast(1, "bigint").alias("sample"), cast(2, "double").alias("ranking_score"))


def ranking_issues(spark: SparkSession, root: str, contract: DataFrame) -> DataFrame:
    """(job, issue, detail): breaches of the ranking tables, by line or by sample."""
    rows = rankings(spark, root)
    header = ranking_lines(spark, root).filter("line = 1").filter(F.col("value") != HEADER).select("job", F.lit("header_invalid").alias("issue"), F.col("value").alias("detail"))
    at = F.concat(F.lit("line "), F.col("line").cast("string"))
    score = F.col("ranking_score")
    unread = F.col("seed").isNull() | F.col("sample").isNull() | score.isNull()
    issue = F.when(F.col("fields") != 3, "columns_invalid").when(unread, "parse_failed").when(F.isnan(score) | ~score.between(LOW, HIGH), "score_invalid")
    by_line = rows.select("job", issue.alias("issue"), at.alias("detail")).filter("issue IS NOT NULL")
    named = rows.filter(~unread).withColumn("output", _output())
    repeated = named.groupBy("job", "output").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("job", F.lit("sample_repeated"), "output")
    wanted = contract.select("job", _output().alias("output"))
    missing = wanted.join(named, ["job", "output"], "left_anti").select("job", F.lit("sample_missing"), "output")
    surplus = named.join(wanted, ["job", "output"], "left_anti").select("job", F.lit("sample_surplus"), "output").distinct()
    return reduce(DataFrame.union, [header, by_line, repeated, missing, surplus])


def summaries(spark: SparkSession, root: str, pattern: str, up: int) -> DataFrame:
    """The summaries of jobs or samples with the folder that holds each, unreadable ones with null fields."""
    kind = "ranking_score double, iptm double, ptm double, fraction_disordered double, has_clash double"
    read = spark.read.schema(kind).option("multiLine", True).json(f"{root}/{pattern}")
    return read.select(_job_of("_metadata.file_path", up).alias("job"), _job_of("_metadata.file_path", 2).alias("output"), "*")


def sample_summaries(spark: SparkSession, root: str) -> DataFrame:
    return summaries(spark, root, "*/*/*_summary_confidences.json", 3)


def score_issues(spark: SparkSession, root: str) -> DataFrame:
    """(job, issue, detail): summaries that can't be read or don't agree with the ranking table."""
    ranked = rankings(spark, root).select("job", _output().alias("output"), F.col("ranking_score").alias("listed"))
    told = sample_summaries(spark, root).select("job", "output", "ranking_score")
    unread = told.filter("ranking_score IS NULL").select("job", F.lit("summary_unreadable").alias("issue"), F.col("output").alias("detail"))
    both = told.join(ranked, ["job", "output"])
    differ = both.filter(F.abs(F.col("ranking_score") - F.col("listed")) > TOLERANCE).select("job", F.lit("sample_score_differs"), "output")
    best = ranked.groupBy("job").agg(F.max("listed").alias("listed"))
    top = summaries(spark, root, "*/*_summary_confidences.json", 2).select("job", "ranking_score").join(best, "job")
    unlike = F.col("ranking_score").isNull() | (F.abs(F.col("ranking_score") - F.col("listed")) > TOLERANCE)
    return unread.union(differ).union(top.filter(unlike).select("job", F.lit("job_score_differs"), F.col("ranking_score").cast("string")))


def prediction_issues(spark: SparkSession, root: str, contract: DataFrame) -> DataFrame:
    """(job, issue, detail): all breaches of a folder of predictions; no rows for one that keeps its contract."""
    return file_issues(spark, root, contract).union(ranking_issues(spark, root, contract)).union(score_issues(spark, root))


def checked_predictions(spark: SparkSession, root: str, contract: DataFrame) -> DataFrame:
    """(job, output, ranking_score, iptm): the selected sample of each job, by score, then iptm, then name.

    Any breach of the contract stops it, with the first by job, issue and detail.
    """
    bad = prediction_issues(spark, root, contract).agg(F.min(F.struct("job", "issue", "detail")).alias("at")).first()["at"]
    if bad is not None:
        raise ValueError(f"{bad['issue']}: {bad['job']}: {bad['detail']}")
    found = sample_summaries(spark, root)
    best = F.struct((-F.col("ranking_score")).alias("s"), (-F.col("iptm")).alias("i"), "output")
    return found.groupBy("job").agg(F.min_by(F.struct("output", "ranking_score", "iptm"), best).alias("best")).select("job", "best.*")
