"""The corpus pipeline: each stage works on all documents that its predecessor kept, read again from Parquet.

In every stage a null text counts as empty, each row is a document of its own whatever rows share its doc_id or its text
(but rows that agree in all columns besides the text are counted once where line dedup counts a line's documents),
a null doc_id is an id (smaller than all in line dedup, after all in near-dedup), an empty table gives an empty table, and
columns besides doc_id and text go through under their names, whatever these are; only n_chars, where there is one, follows
a text that changed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm import bpe, decontaminate, line_dedup, quality, simhash
from veridex.llm.queries_scans import digests
from veridex.llm.shared_store import written
from veridex.sources.tables import table


def _rest(docs: DataFrame) -> DataFrame:
    """The documents as (key, text); the key holds all other columns, doc_id first, so no join brings them back."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(F.struct("doc_id", *others).alias("key"), "text")


def _documents(found: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents again, with the texts that a stage left."""
    whole = found.select("key.*", "text")
    return (whole.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in columns else whole).select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed; an empty text fails."""
    cleaned = quality.clean_lines(_rest(docs), id_col="key")
    # a verdict that isn't deterministic stays above the steps it is made of; pushed below, each would be copied into it
    verdict = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    return _documents(cleaned.withColumn("kept", verdict).filter("kept"), docs.columns)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the last of them; a document without a word left goes."""
    left = line_dedup.dedup_lines(_rest(docs), id_col="key")
    verdict = F.col("text").rlike(r"[^\x20\x09-\x0D]") & (F.monotonically_increasing_id() >= 0)
    return _documents(left.withColumn("full", verdict).filter("full"), docs.columns)


def _hashed(columns: list[str], seed: int) -> Column:
    """64 bits of a row; which of its columns are null counts too."""
    return F.xxhash64(F.lit(seed), *columns, *(F.col(c).isNull() for c in columns))


def near_duplicates_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: of its smallest doc_id, and among rows of that id by a hash of the row.

    A null doc_id comes after all others.  Rows that are equal in all columns are near-duplicates too: one of them stays.
    """
    columns = docs.columns
    marked = docs.withColumn("_a", _hashed(columns, 0)).withColumn("_b", _hashed(columns, 1))
    key = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.col("_a").alias("a"), F.col("_b").alias("b"))
    found = simhash.near_duplicates(marked.select(key.alias("key"), "text"), id_col="key")
    chosen = found.filter(F.col("key").eqNullSafe(F.col("component"))).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    chosen = written(chosen.select(F.col("key.doc_id").alias("_id"), F.col("key.a").alias("_ka"), F.col("key.b").alias("_kb"), "rows"))

    same = (F.col("_a") == F.col("_ka")) & (F.col("_b") == F.col("_kb")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    once = marked.join(chosen.filter("rows = 1"), same, "left_semi").select(*columns)
    return once.union(marked.join(chosen.filter("rows > 1"), same, "left_semi").select(*columns).distinct())


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window, whatever rows share their doc_id; a null doc_id is an id like any other."""
    columns = docs.columns
    key = F.concat(F.hex(_hashed(columns, 0)), F.lit("-"), F.hex(_hashed(columns, 1)))
    marked = docs.withColumn("_key", key)
    found = decontaminate.decontaminate(marked.select("_key", "text"), table(spark, sf_dir, "benchmark"), id_col="_key")
    return marked.join(found.filter("NOT contaminated").select("_key"), "_key", "left_semi").select(*columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of each row that is left; no other column."""
    return digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines_once),
    ("SimHash near-dedup", near_duplicates_once),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", encoded),
]

#: Near-duplicate classes and token ids have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs)
    return docs
