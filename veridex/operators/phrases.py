"""Longest phrases that several groups share, grown word by word.

A phrase that enough groups share begins with one that they share too.  So a phrase of n words is only looked at where the
one of n - 1 words before it was found shared, as a walk down a trie stops at the first unknown prefix.  Phrases are two
64-bit hashes, so what moves at a length is a few numbers for each place still alive; the places of a text that are still
alive come back to it as one list of numbers of words, which alone is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.sources.shared import written


def _named(phrase: Column) -> list[Column]:
    """Two hashes of an array of words."""
    return [F.xxhash64(F.lit(i), phrase).alias(f"h{i}") for i in range(2)]


def longest_shared(texts: DataFrame, ids: list[str], words: str, group: str, least: int, longest: int) -> DataFrame:
    """(ids…, n, i, phrase): the first longest phrase, of up to longest words, of each row that rows of at least least
    groups share; of equal numbers of words the one with the most characters, then the first.  i counts words from 0.

    Rows without a shared word have no result; a null group is none, and null words are none.
    """
    rows = written(texts.select(*ids, F.col(group).alias("_group"), F.col(words).alias("_words")).withColumn("_row", F.monotonically_increasing_id()))
    places = rows.select("_row", "_group", F.posexplode("_words").alias("i", "word"))
    alive = places.select("_row", "_group", "i", *_named(F.array("word")))
    found = None
    for n in range(1, longest + 1):
        shared = alive.groupBy("h0", "h1", "_group").agg(F.lit(1).alias("one")).groupBy("h0", "h1").agg(F.count("_group").alias("groups"))
        shared = written(shared.filter(F.col("groups") >= least).select("h0", "h1"))
        spots = alive.select("_row", "i", "h0", "h1").join(shared, ["h0", "h1"], "left_semi").groupBy("_row").agg(F.sort_array(F.collect_list("i")).alias("spots"))
        spots = written(spots)
        own = spots.withColumn("n", F.lit(n))
        found = own if found is None else found.unionByName(own)
        if n == longest or shared.isEmpty():
            break
        inside = F.filter("spots", lambda i: i + n < F.size("_words"))  # noqa: B023
        alive = rows.join(spots, "_row").select("_row", "_group", "_words", F.explode(inside).alias("i"))
        alive = alive.select("_row", "_group", "i", *_named(F.slice("_words", F.col("i") + 1, n + 1)))
    last = found.groupBy("_row").agg(F.max("n").alias("n"), F.max_by("spots", "n").alias("spots")).join(rows, "_row")

    def place(i: Column) -> Column:
        phrase = F.array_join(F.slice("_words", i + 1, F.col("n")), " ")
        return F.struct((-F.length(phrase)).alias("shortness"), i.alias("i"), phrase.alias("phrase"))

    best = last.select(*ids, "n", F.array_min(F.transform("spots", place)).alias("best"))
    return best.select(*ids, "n", "best.i", "best.phrase")
