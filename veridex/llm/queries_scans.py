"""Queries of the row-wise text operators: license scans, BPE round trips, token counts and language-model scores."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm import bpe, licenses, lm_score, token_counts
from veridex.sources.tables import table


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of encoded documents."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


QUERIES = {
    "op3_license_scan": op3_license_scan,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_token_counts": op8_token_counts,
    "op10_lm_score": op10_lm_score,
}

ORACLES: dict[str, str] = {}
