"""File sources and sinks: JSON lines, single documents, contracted CSV, stanza text, id lists and split writers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One record a line; blank lines are skipped.  strict stops at a malformed line, else it comes as _corrupt_record."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def json_rows(spark: SparkSession, path: str, schema: str, rows: str = "rows") -> DataFrame:
    """The records under one key of a whole-file JSON object."""
    whole = spark.read.schema(f"{rows} array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.inline(rows))


def folds(spark: SparkSession, pattern: str, schema: str, fold: str = r"fold[_-]?(\d+)") -> DataFrame:
    """JSON lines of many files, with the fold's number taken from the file's name."""
    name = F.regexp_extract(F.col("_metadata.file_name"), fold, 1)
    read = spark.read.schema(schema).option("mode", "FAILFAST").json(pattern)
    return read.select("*", F.nullif(name, F.lit("")).cast("int").alias("fold"))


def ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, trimmed, without blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def stanzas(spark: SparkSession, path: str, kind: str = "Term") -> DataFrame:
    """(id, name, synonyms, obsolete) of the stanzas of an ontology text; exact and narrow synonyms only."""
    block = spark.read.text(path, lineSep="\n\n").select(F.split("value", "\n").alias("lines")).filter(F.array_contains("lines", f"[{kind}]"))

    def tagged(tag: str) -> Column:
        return F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit(f"{tag}: "))), lambda x: F.substring(x, len(tag) + 3, 1 << 30))

    synonyms = F.filter(tagged("synonym"), lambda x: x.rlike(r'" (EXACT|NARROW)'))
    return block.select(
        F.get(tagged("id"), F.lit(0)).alias("id"),
        F.get(tagged("name"), F.lit(0)).alias("name"),
        F.transform(synonyms, lambda x: F.regexp_extract(x, r'^"(.*)" ', 1)).alias("synonyms"),
        F.array_contains("lines", "is_obsolete: true").alias("obsolete"),
    )


@dataclass
class Contract:
    """What a CSV source has to be: its columns, in types, its digest, and its numbers of rows and of distinct targets."""

    columns: dict[str, str]
    target: str
    rows: int | None = None
    targets: int | None = None
    sha256: str | None = None
    drop: list[str] = field(default_factory=list)


def contracted_csv(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """The allowed columns of a CSV with a header, cast to their types; anything off the contract stops the read.

    A value that doesn't parse as its type stops the query that meets it.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = sorted(set(contract.columns) - set(raw.columns))
    surplus = sorted(set(raw.columns) - set(contract.columns) - set(contract.drop))
    if missing or surplus:
        raise ValueError(f"columns missing: {missing}; not in the contract: {surplus}")
    if contract.sha256:
        digests = [r.d for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).limit(2).collect()]
        if digests != [contract.sha256]:
            raise ValueError("the file's digest is not the contract's")
    if contract.rows is not None or contract.targets is not None:
        rows, targets = raw.agg(F.count(F.lit(1)), F.countDistinct(contract.target)).first()
        for name, found, wanted in (("rows", rows, contract.rows), ("targets", targets, contract.targets)):
            if wanted is not None and found != wanted:
                raise ValueError(f"{found} {name}; the contract has {wanted}")
    return raw.select(*(F.col(name).cast(kind).alias(name) for name, kind in contract.columns.items()))


def write_json_lines(frame: DataFrame, path: str, order: list[str]) -> None:
    """Sorted JSON lines with the fields in alphabetical order, split over files by ranges of the order."""
    frame.select(*sorted(frame.columns)).orderBy(*order).write.mode("errorifexists").json(path)


def write_splits(frame: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split."""
    frame.write.mode("errorifexists").partitionBy(split).parquet(path)
