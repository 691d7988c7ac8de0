import random

import pytest
from pyspark.sql import functions as F

from veridex.functions import nested, similarity


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert similarity.common_subsequence(a, b) == brute_lcs(a, b)


def test_ratios():
    assert similarity.ratio("", "") == 100.0 and similarity.ratio("a", "") == 0.0
    assert similarity.ratio("this is a test", "this is a test!") == pytest.approx(96.5517, abs=1e-3)
    assert similarity.set_ratio("fuzzy was a bear", "bear a was fuzzy fuzzy") == 100.0
    assert similarity.set_ratio("", "x") == 0.0


@pytest.mark.parametrize(
    ("text", "want"),
    [('```json\n{"a": 1}\n```', '{"a": 1}'), ("so {broken", None), ("", None), ('x {"a": {"b": 2}} y', '{"a": {"b": 2}}'), ('{"a": ', None), ("{a} and {b}", None)],
)
def test_embedded_json(spark, text, want):
    assert spark.range(1).select(nested.embedded_json(F.lit(text)).alias("x")).first().x == want


def test_calls_citations_and_aliases(spark):
    rows = [('{"calls": ["search", {"name": "both"}, "search"], "cited": "N1 "}',), ('{"sources": ["N2", " ", "N2", "N3"]}',), ("{}",)]
    p = F.col("p")
    got = spark.createDataFrame(rows, "p string").select(nested.called_tools(p, {"both": ["read", "verify"]}).alias("t"), nested.citations(p, "cited", "sources").alias("c")).collect()
    assert [(r.t, r.c) for r in got] == [(["search", "read", "verify"], ["N1"]), ([], ["N2", "N3"]), ([], [])]
    names = spark.createDataFrame([(" Accept ",), ("?",)], "a string").select(nested.canonical_name(F.col("a"), {"accept": "ground"}).alias("n")).collect()
    assert [r.n for r in names] == ["ground", None]


def slow_ratio(a, b):
    """100 * 2 * LCS / lengths by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200 * row[-1] / (len(a) + len(b))


def test_registered_name_queries_equal_brute_force(spark):
    from veridex.plans import selection, summaries

    sf = "/root/testdata/sf0.001"
    part = [(r.p_partkey, r.p_brand, r.p_name.lower()) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    want = []
    for brand in {b for _, b, _ in part}:
        forms = {n for _, b, n in part if b == brand}
        short = min(forms, key=lambda n: (len(n), n))
        others = [(round(slow_ratio(n, short), 6), n) for n in forms if n != short]
        want += [(brand, form, ratio) for ratio, form in [min(others)]] if others else []
    got = sorted(map(tuple, summaries.dissimilar(spark, sf).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, sorted(want)))

    tokens = lambda n: " ".join(sorted(n.split()))
    names, queries = {tokens(n) for _, _, n in part}, {tokens(n) for k, _, n in part if k % 50 == 0}
    want = {(q, n) for q in queries for n in names if slow_ratio(q, n) >= 90}
    assert {(r["query"], r["name"]) for r in selection.token_sort(spark, sf).collect()} == want
