"""Joins of names by edit ratios, with candidates from rarest-first prefixes of their grams and tokens.

Two names whose ratio reaches a cutoff leave so few characters unmatched that so many of each one's grams survive.  With
the grams of all names in one order, rarest first, one of the first grams of the one is then among the first of the other,
so only those are joined, and only for lengths that allow the cutoff.  Set ratios add tokens: where the shared tokens alone
reach the cutoff, they are most of one of the names, and one of that name's rarest tokens is among them.

Frequencies are kept for a fixed number of hashed buckets, so what tasks are sent has a size that no input changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions import similarity

BUCKETS = 1 << 16
LEAST_CUTOFF = 70.0


def grams_of(name: Column) -> Column:
    """Pairs of neighbouring characters of a name with a blank at both ends; for tokens joined by blanks, those of the tokens."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substr(padded, i, F.lit(2)))


def tokens_of(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(name, r"\s+"), lambda x: x != "")))


def frequencies(frames: list[DataFrame], pieces: Callable[[Column], Column]) -> np.ndarray:
    """How many names hold a piece of each bucket; BUCKETS counts, whatever the names."""
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    bucket = F.transform(pieces(F.col("name")), lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)))
    counted = every.select(F.explode(F.array_distinct(bucket)).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[counted["b"].to_numpy()] = counted["n"].to_numpy()
    return out


def lengths_for(length: int, cutoff: float) -> range:
    """The lengths of names whose ratio with one of this length can reach the cutoff."""
    share = cutoff / (200.0 - cutoff)
    return range(int(np.ceil(length * share - 1e-9)), int(np.floor(length / share + 1e-9)) + 1)


def grams_lost(length: int, other: int, cutoff: float) -> int:
    """At most so many of a name's grams are gone in a name of the other length: two for each character that the other
    hasn't, one for each place where it has one more."""
    matched = int(np.ceil(cutoff * (length + other) / 200.0 - 1e-9))
    return 2 * (length - matched) + (other - matched)


def _listed(frame: DataFrame, kind: str, pieces: Callable[[Column], Column], keys: Callable[[str, list[str], list[int]], Iterator]) -> DataFrame:
    """(name, key, length): what keys() gives for each name, its pieces and their buckets."""
    source = frame.select("name", pieces(F.col("name")).alias("p")).select("name", "p", F.transform("p", lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")).alias("b"))

    def run(batches):
        for batch in batches:
            names, out = [], ([], [])
            for name, own, buckets in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                for key, length in keys(name, own, buckets):
                    names.append(name)
                    out[0].append(key)
                    out[1].append(length)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], names=["name", "key", "length"])

    return source.mapInArrow(run, "name string, key string, length int")


def _in_order(pieces: list[str], buckets: list[int], often: np.ndarray) -> list[tuple[int, str, int]]:
    """(frequency, piece, which of its like it is), rarest first."""
    seen: dict[str, int] = {}
    out = []
    for piece, bucket in zip(pieces, buckets, strict=True):
        number = seen[piece] = seen.get(piece, -1) + 1
        out.append((int(often[bucket]), piece, number))
    return sorted(out)


def gram_candidates(queries: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """Distinct (query, name) of which every pair with a ratio of the cutoff is one; both frames have one column, name."""
    often = frequencies([queries, names], grams_of)

    def prefix(name: str, grams: list[str], buckets: list[int], spread: bool):
        length = len(name)
        partners = lengths_for(length, cutoff)
        lost = max((grams_lost(length, other, cutoff) for other in partners), default=0)
        for _, gram, number in _in_order(grams, buckets, often)[: lost + 1]:
            for other in partners if spread else (length,):
                yield f"{gram}{number}", other

    left = _listed(queries, "grams", grams_of, lambda *own: prefix(*own, True)).withColumnRenamed("name", "query")
    right = _listed(names, "grams", grams_of, lambda *own: prefix(*own, False))
    return left.join(right, ["key", "length"]).select("query", "name").distinct()


def token_candidates(queries: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """(query, name) of which every pair is one whose shared tokens alone have a ratio of the cutoff with all of one name's."""
    often, share = frequencies([queries, names], tokens_of), cutoff / (200.0 - cutoff)

    def rarest(name: str, tokens: list[str], buckets: list[int]):
        """The rarest tokens that can't all be missing: what is missing has at most 1 - share of the characters."""
        spare = (1.0 - share) * len(" ".join(tokens)) + 1e-9
        for _, token, _ in _in_order(tokens, buckets, often):
            yield token, 0
            spare -= len(token) + 1  # with the blank that parts it from the shared ones
            if spare < 0:
                return

    def every(name: str, tokens: list[str], buckets: list[int]):
        return ((token, 0) for token in tokens)

    def met(left, right):
        one = _listed(queries, "tokens", tokens_of, left).withColumnRenamed("name", "query")
        return one.join(_listed(names, "tokens", tokens_of, right), "key").select("query", "name")

    return met(rarest, every).union(met(every, rarest)).distinct()


def _checked(cutoff: float) -> None:
    if not LEAST_CUTOFF <= cutoff <= 100:
        raise ValueError(f"a cutoff outside {LEAST_CUTOFF} to 100: grams of short names can't prove it")


def ratio_join(queries: DataFrame, names: DataFrame, query: str, name: str, cutoff: float) -> DataFrame:
    """(query, name, ratio): pairs of different columns whose ratio is at least the cutoff, as those columns.

    Distinct texts only; a null is in no pair, and two empty texts are one.
    """
    _checked(cutoff)
    one, two = (frame.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct() for frame, column in ((queries, query), (names, name)))
    scored = gram_candidates(one, two, cutoff).withColumn("ratio", similarity.indel_ratio("query", "name"))
    return scored.filter(F.col("ratio") >= cutoff).select(F.col("query").alias(query), F.col("name").alias(name), "ratio")


def best_by_tokens(queries: DataFrame, names: DataFrame, query: str, name: str, cutoff: float) -> DataFrame:
    """(query, name, ratio): for each distinct query the name with the best token-set ratio of at least the cutoff, the
    first in order among equals; queries without one, and texts without a token, are left out."""
    _checked(cutoff)
    one, two = (
        frame.select(F.col(column).alias("whole")).filter(F.size(tokens_of(F.coalesce("whole", F.lit("")))) > 0).distinct()
        .withColumn("name", F.array_join(tokens_of(F.col("whole")), " "))
        for frame, column in ((queries, query), (names, name))
    )
    sets, others = one.select("name").distinct(), two.select("name").distinct()
    pairs = gram_candidates(sets, others, cutoff).union(token_candidates(sets, others, cutoff)).distinct()
    scored = pairs.withColumn("ratio", similarity.token_set_ratio("query", "name")).filter(F.col("ratio") >= cutoff)
    # names with one set of tokens have the same ratios: the first of them stands for all
    first = two.groupBy("name").agg(F.min("whole").alias("text"))
    best = scored.join(first, "name").groupBy("query").agg(F.max("ratio").alias("ratio"), F.min_by("text", F.struct(-F.col("ratio"), "text")).alias("text"))
    whole = one.withColumnRenamed("name", "query").join(best, "query")
    return whole.select(F.col("whole").alias(query), F.col("text").alias(name), "ratio")
