"""The inverted file against the exact answer."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridex.operators import vector_index, vectors
from veridex.plans import search

SF = "/root/testdata/sf0.01"


def rows_of(spark, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=16)).tolist(), int(i % 12 // 2)) for i in range(600)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(copies)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


def exact(rows, k, concept=None):
    ids, labels, matrix = [r.vec_id for r in rows], [r.label for r in rows], np.array([r.embedding for r in rows])
    similar, out = np.round(matrix @ matrix.T, 12), {}
    for i, own in enumerate(ids):
        found = sorted((-similar[i, j], other) for j, other in enumerate(ids) if other != own and not (concept and labels[j] == labels[i]))
        out[own] = [other for _, other in found[:k]]
    return out


@pytest.mark.parametrize("concept", [None, "label"])
@pytest.mark.parametrize("block", [8192, 20])
def test_reading_all_lists_is_exact(spark, concept, block):
    rows = rows_of(spark, 1, copies=40)
    index = vector_index.fit(rows, "vec_id", "embedding", 3, concept=concept)
    every = vector_index.Index(index.centroids, len(index.centroids))
    got = vector_index.top_k(every, rows, rows, "vec_id", "embedding", 3, concept=concept, block=block).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query"], r.rn)):
        found.setdefault(r["query"], []).append(r["match"])
    assert found == exact(rows.collect(), 3, concept) and len(got) == 640 * 3


def test_few_lists_of_clustered_rows_reach_the_recall(spark):
    rows = rows_of(spark, 2)
    index = vector_index.fit(rows, "vec_id", "embedding", 5)
    got = vector_index.top_k(index, rows, rows, "vec_id", "embedding", 5).select("query", "match").collect()
    want = {(q, m) for q, found in exact(rows.collect(), 5).items() for m in found}
    assert len(want & {(r["query"], r["match"]) for r in got}) >= 0.9 * len(want)
    assert len(index.centroids) == 24 and index.probes < 12


def test_rows_without_a_vector_and_tiny_tables(spark):
    rows = rows_of(spark, 3).limit(3).union(spark.createDataFrame([(9000, None, 1)], "vec_id bigint, embedding array<double>, label int"))
    held = rows.filter("embedding IS NOT NULL")
    index = vector_index.fit(held, "vec_id", "embedding", 2)
    assert vector_index.top_k(index, rows, rows, "vec_id", "embedding", 2).count() == 6
    none = rows.limit(0)
    assert vector_index.top_k(vector_index.fit(none, "vec_id", "embedding", 2), none, none, "vec_id", "embedding", 2).count() == 0


def test_registered_searches(spark):
    recall = search.index_recall(spark, SF).first()
    assert recall.reached and recall.pairs == 50
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = search.all_nearest(spark, SF)
    assert got.count() == 5 * rows.count() and got.select("query").distinct().count() == rows.count()
    sure = got.join(vectors.top_k(rows.filter("vec_id % 50 = 0"), rows, "vec_id", "embedding", 5).select("query", "match", F.col("similarity").alias("s")), ["query", "match"])
    assert sure.filter(F.abs(F.col("s") - F.col("similarity")) > 1e-9).count() == 0
    swept = {r.threshold: (r.n, r.false_ground) for r in search.all_nil_rejection(spark, SF).collect()}
    want = {r.vec_id: r for r in rows.collect()}
    best = exact(list(want.values()), 1, "label")
    for threshold, (n, reached) in swept.items():
        true = sum(float(np.dot(want[q].embedding, want[m[0]].embedding)) >= threshold for q, m in best.items())
        assert n == len(want) and 0.9 * true - 1 <= reached <= true


@pytest.fixture
def many_partitions(spark):
    """Small shuffles stay apart, as those of large tables do."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_the_exact_way_over_several_blocks(spark, many_partitions):
    """Blocks of both sides meet: each query sees all vectors, however they are dealt out."""
    rows = rows_of(spark, 4, copies=9)
    got = vectors.top_k(rows.filter("vec_id % 3 = 0"), rows, "vec_id", "embedding", 4, block=150).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query"], r.rn)):
        found.setdefault(r["query"], []).append(r["match"])
    assert found == {q: m for q, m in exact(rows.collect(), 4).items() if q % 3 == 0}


def test_what_a_task_holds_depends_neither_on_lists_nor_on_blocks():
    """Filing rows under most of many lists, and the products of two whole blocks."""
    rng = np.random.default_rng(5)
    rows, centroids = rng.normal(size=(3000, 8)), rng.normal(size=(700, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), 8)], names=["id", "v"])
    found = [set() for _ in rows]
    tracemalloc.start()
    for out in vector_index.filed(centroids, 400)([batch]):
        assert out.num_rows <= vector_index.FILED_ROWS
        for i, own in zip(out["id"].to_pylist(), out["list"].to_pylist(), strict=True):
            found[i].add(own)
    want = np.argsort(-(rows @ centroids.T), axis=1)[:, :400]
    assert all(own == set(w.tolist()) for own, w in zip(found, want, strict=True))
    one, two = rng.normal(size=(8192, 8)), rng.normal(size=(8192, 8))
    del found, want
    tracemalloc.reset_peak()
    parts = list(vectors.top_products(one, two, np.arange(8192), 3))
    assert tracemalloc.get_traced_memory()[1] < 200_000_000  # all products are 537 MB, and were held several times
    tracemalloc.stop()
    at, column, _ = (np.concatenate(x) for x in zip(*parts, strict=True))
    some = np.arange(0, 8192, 500)
    want = np.argsort(-(one[some] @ two.T), axis=1)[:, :3]
    assert at.tolist() == np.repeat(np.arange(8192), 3).tolist() and column.reshape(-1, 3)[some].tolist() == want.tolist()
