"""Greedy selection against the loop, and its number of passes along a chain."""

import random

import duckdb
import pytest

from veridex.operators import greedy
from veridex.plans import selection


def loop(rows, keys):
    used, kept = [set() for _ in range(keys)], []
    for row in sorted(rows):
        own = row[1 : 1 + keys]
        if not any(k in u for k, u in zip(own, used, strict=True) if k is not None):
            kept.append(row)
            for k, u in zip(own, used, strict=True):
                u.add(k)
    return kept


@pytest.mark.parametrize(("seed", "n", "values"), [(1, 60, 8), (2, 120, 50), (3, 200, 200), (4, 40, 2)])
def test_equals_the_loop(spark, seed, n, values):
    rng = random.Random(seed)
    value = lambda p: None if rng.random() < 0.05 else f"{p}{rng.randrange(values)}"
    rows = [(i, value("a"), value("b"), value("c")) for i in rng.sample(range(10_000), n)]
    got = greedy.greedy_unique(spark.createDataFrame(rows, "i int, a string, b string, c string").repartition(5), ["a", "b", "c"], ["i"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(loop(rows, 3), key=str)


def test_a_chain_of_ten_thousand_ends_in_thirty_rounds(spark, monkeypatch):
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(10_000)]  # each row shares a key with the next
    passes = []
    written = greedy.written
    monkeypatch.setattr(greedy, "written", lambda frame: passes.append(1) or written(frame))
    got = greedy.greedy_unique(spark.createDataFrame(rows, "i int, a string, b string").repartition(5), ["a", "b"], ["i"])
    assert sorted(r.i for r in got.collect()) == list(range(0, 10_000, 2)) and len(passes) <= 30


def test_a_hot_key_and_an_empty_table(spark):
    rows = [(i, "all", f"b{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "i int, a string, b string")
    assert [r.i for r in greedy.greedy_unique(frame, ["a", "b"], ["i"]).collect()] == [0]
    assert greedy.greedy_unique(frame.limit(0), ["a", "b"], ["i"]).count() == 0


def test_the_registered_query_equals_the_loop(spark):
    d = "/root/testdata/sf0.01"
    part = duckdb.sql(f"SELECT p_partkey, p_name, p_brand FROM '{d}/part.parquet'").fetchall()
    assert sorted(map(tuple, selection.t13(spark, d).collect())) == loop(part, 2)
