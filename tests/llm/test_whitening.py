"""Whitening against an eigendecomposition of the exact covariance."""

import random
from fractions import Fraction

import numpy as np
import pytest

from veridex.llm import queries_turns, whitening

SF = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows, components=4, scale=256):
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, axes = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        own = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)]) @ axes / np.sqrt(e)
        out.setdefault(i, []).append((n, deviation, own, e / values.sum()))
    return out


def agree(got, want):
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert set(by_id) == set(want)
    signs = None
    for i, rows in by_id.items():
        rows.sort(key=lambda r: r.component)
        copies = len(want[i])
        n, deviation, own, shares = want[i][0]
        assert [r.component for r in rows] == [c for c in range(1, len(own) + 1) for _ in range(copies)]
        assert {(r.n, r.deviation) for r in rows} == {(n, deviation)}
        found = np.array([r.whitened for r in rows[::copies]])
        if signs is None and np.abs(own).min() > 1e-3:
            signs = np.sign(found * own)
        if signs is not None:
            assert found == pytest.approx(own * signs, abs=1e-8)
        assert np.array([r.explained for r in rows[::copies]]) == pytest.approx(shares, rel=1e-6)
        assert all(r.identity_error <= 1e-9 for r in rows)


def test_op11_equals_brute_force(spark):
    got = queries_turns.op11_embedding_whitening(spark, SF)
    assert got.columns == COLUMNS
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    agree(got.collect(), brute(rows))


def test_nulls_repeats_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + d) for d in range(6)]) for i in range(60)]
    usual = rows + [(7, rows[7][1]), (None, rows[3][1]), (90, rows[5][1])]
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5), (104, []), (105, [1.0]), (106, [1e300] + [0.0] * 5)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in usual + odd], "vec_id bigint, embedding array<double>, n int").repartition(7)
    got = whitening.whiten(frame)
    assert got.columns == COLUMNS
    agree(got.collect(), brute(usual))


def test_tables_without_variance(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert make([]).count() == 0 and make([(1, None)]).count() == 0 and make([(1, [0.5, 2.0]), (2, [0.5, 2.0])]).count() == 0
    got = make([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [3.0, 1.0])]).collect()
    assert [(r.vec_id, r.component, r.explained) for r in sorted(got)] == [(i, 1, 1.0) for i in (1, 2, 3)]


def test_a_merge_loses_nothing():
    rng = np.random.default_rng(0)
    rows = rng.integers(-300, 300, (500, 12)) + np.arange(12) * 1000
    whole, parts = whitening.Part(rows), [whitening.Part(p) for p in np.array_split(rows, 9)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.merge(part)
    assert merged.n == 500 and merged.sums == whole.sums == [int(s) for s in rows.sum(0)]
    assert merged.axes.T @ merged.axes == pytest.approx(whole.axes.T @ whole.axes, rel=1e-10, abs=1e-6)


def test_a_deviation_is_exact_or_null():
    rows = np.array([[2**40, 0], [3, 4], [2**30, 1]])
    assert whitening.deviations(rows, 1, [0, 0]) == [None, 25, 2**60 + 1]
    assert whitening.deviations(np.array([[3, 4]]), 2, [1, 1]) == [25 + 49]
