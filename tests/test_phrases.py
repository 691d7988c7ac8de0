"""Longest shared phrases against a count of all n-grams."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veridex.operators import phrases
from veridex.plans import selection


def brute(rows, least, longest):
    groups = {}
    for _, group, words in rows:
        for n in range(1, longest + 1):
            for i in range(len(words or []) - n + 1):
                groups.setdefault(tuple(words[i : i + n]), set()).add(group)
    out = set()
    for key, _, words in rows:
        best = [(-n, -len(" ".join(words[i : i + n])), i) for n in range(1, longest + 1) for i in range(len(words or []) - n + 1) if len(groups[tuple(words[i : i + n])] - {None}) >= least]
        if best:
            n, _, i = min(best)
            out.add((key, -n, i, " ".join(words[i : i - n])))
    return out


@pytest.mark.parametrize(("seed", "size"), [(1, 3), (2, 12), (3, 60)])
def test_equals_all_grams(spark, seed, size):
    rng = random.Random(seed)
    words = [f"w{'x' * (i % 4)}{i}" for i in range(size)]
    rows = [(i, rng.choice([None, *range(12)]), [rng.choice(words) for _ in range(rng.randrange(12))]) for i in range(60)] + [(99, 1, None)]
    frame = spark.createDataFrame(rows, "k int, g int, w array<string>").repartition(4)
    got = phrases.longest_shared(frame, ["k"], "w", "g", 3, 6).collect()
    assert {tuple(r) for r in got} == brute(rows, 3, 6) and len(got) == len(brute(rows, 3, 6))


def test_the_shuffle_is_a_third_of_all_grams(spark):
    """Bytes written to shuffles by the walk, held against six grams a word."""
    words = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").select("conv_id", "turn", F.split(F.lower("text"), " +").alias("ws"))
    def shuffled(work):
        before = _written(spark)
        work()
        return _written(spark) - before

    def every():
        grams = F.flatten(F.array(*(F.transform(F.sequence(F.lit(0), F.greatest(F.size("ws") - n, F.lit(0))), lambda i: F.array_join(F.slice("ws", i + 1, n), " ")) for n in range(1, 7))))  # noqa: B023
        known = words.select("conv_id", "turn", F.explode(F.filter(grams, lambda x: x.isNotNull())).alias("phrase"))
        shared = known.groupBy("phrase").agg(F.countDistinct("conv_id").alias("c")).filter("c >= 3")
        known.join(shared.hint("shuffle_hash"), "phrase").groupBy("conv_id", "turn").count().collect()

    walk = shuffled(lambda: phrases.longest_shared(words, ["conv_id", "turn"], "ws", "conv_id", 3, 6).collect())
    assert walk * 3 < shuffled(every)


def _written(spark):
    """Bytes that tasks have written to shuffles so far."""
    time.sleep(1)  # for the listener
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_the_registered_query_keeps_its_rows(spark):
    assert selection.f6(spark, "/root/testdata/sf0.001").count() > 0


def test_places_are_written_as_one_list_a_text(spark, monkeypatch):
    seen, write = [], phrases.written
    monkeypatch.setattr(phrases, "written", lambda frame: seen.append(set(frame.columns)) or write(frame))
    frame = spark.createDataFrame([(i, i, ["a", "b", f"c{i}"]) for i in range(5)], "k int, g int, w array<string>")
    assert {tuple(r) for r in phrases.longest_shared(frame, ["k"], "w", "g", 3, 6).collect()} == {(i, 2, 0, "a b") for i in range(5)}
    assert {"_row", "spots"} in seen and not any({"i", "h0"} <= columns for columns in seen)
