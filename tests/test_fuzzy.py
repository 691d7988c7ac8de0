"""Candidate search for edit ratios against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from veridex.functions import similarity
from veridex.operators import fuzzy
from veridex.plans import selection

SF = "/root/testdata/sf0.001"


def frame(spark, names, column):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


@pytest.mark.parametrize("cutoff", [70.0, 85.0, 90.0, 100.0])
def test_ratio_join_equals_all_pairs(spark, cutoff):
    rng = random.Random(int(cutoff))
    names = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 16))) for _ in range(120)] + ["", "a", "aaaaaaaaaaaa"]
    queries = [n[:3] + rng.choice("abcd") + n[3:] for n in names[:60]] + ["", "zz", "aaaaaaaaaa"]
    want = {(q, n) for q in queries for n in names if similarity.ratio(q, n) >= cutoff}
    got = fuzzy.ratio_join(frame(spark, [*queries, None], "q"), frame(spark, [*names, None], "n"), "q", "n", cutoff).collect()
    assert {(r.q, r.n) for r in got} == want and len(got) == len(want)
    assert all(r.ratio == similarity.ratio(r.q, r.n) for r in got)


@pytest.mark.parametrize("cutoff", [70.0, 88.0])
def test_the_best_by_token_sets_equals_all_pairs(spark, cutoff):
    rng = random.Random(3)
    words = ["acid", "sodium", "salt", "ab", "a", "xenon", "calcium", "hydro", "chlor", "ide"]
    typo = lambda w: w[: rng.randint(0, len(w))] + rng.choice("xyz") + w[rng.randint(0, len(w)) :] if rng.random() < 0.3 else w
    make = lambda: " ".join(typo(rng.choice(words)) for _ in range(rng.randint(0, 5)))
    queries, names = [make() for _ in range(80)], [make() for _ in range(150)] + ["sodium " * 3 + "  salt"]
    want = {}
    for q in queries:
        scored = [(-similarity.set_ratio(q, n), n) for n in names if n.split() and q.split()]
        if scored and -min(scored)[0] >= cutoff:
            want[q] = (min(scored)[1], -min(scored)[0])
    got = fuzzy.best_by_tokens(frame(spark, [*queries, None], "q"), frame(spark, [*names, None], "n"), "q", "n", cutoff).collect()
    assert {r.q: (r.n, r.ratio) for r in got} == want and len(got) == len(want) > 20


def test_registered_searches_equal_all_pairs(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").collect()
    names = {p.p_name.lower() for p in part}
    typed = {p.p_name.lower() + "s" for p in part if p.p_partkey % 50 == 0}
    want = {(q, n, round(similarity.ratio(q, n), 3)) for q in typed for n in names if similarity.ratio(q, n) >= 85}
    assert {(r["query"], r["name"], r["ratio"]) for r in selection.fuzzy_names(spark, SF).collect()} == want
    want = set()
    for p in part:
        if p.p_partkey % 50 == 0:
            q = f"{p.p_type.split(' ')[0]} {p.p_name[1:]}".lower()
            score, name = min((-similarity.set_ratio(q, n), n) for n in names)
            want |= {(q, name, round(-score, 3))} if -score >= 70 else set()
    assert {(r["query"], r["name"], r["ratio"]) for r in selection.best_token_set(spark, SF).collect()} == want


def test_common_grams_are_no_keys(spark):
    """Every name begins with the same words, yet no key of the candidates holds over a tenth of the names."""
    rng = random.Random(4)
    names = ["sodium salt of " + "".join(rng.choice("bcdfghjklmnpqrtvwxz") for _ in range(12)) for _ in range(400)]
    one = frame(spark, names, "name")
    often = fuzzy.frequencies([one], fuzzy.grams_of)
    listed = fuzzy._listed(one, "grams", fuzzy.grams_of, lambda name, grams, buckets: ((f"{g}{i}", 0) for _, g, i in fuzzy._in_order(grams, buckets, often)[: fuzzy.grams_lost(27, 27, 90.0) + 1]))
    most = listed.groupBy("key").agg(F.countDistinct("name").alias("n")).agg(F.max("n")).first()[0]
    assert most < 40
    with pytest.raises(ValueError, match="cutoff"):
        fuzzy.ratio_join(one, one, "name", "name", 60.0)
