"""The searches of all vectors on odd tables, against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from veridex.operators import vectors
from veridex.plans import registry


def plain_rows(n, seed=1, width=8):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, width))
    return [[i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 4))] for i, v in enumerate(made)]


def odd_rows(n):
    rows = plain_rows(n)
    for i in range(0, n, 9):
        rows[i][1] = rows[4][1]  # copies
    for i in range(2, n, 31):
        rows[i][1] = None
    for i in range(3, n, 37):
        rows[i][2] = None
    rows[11][1] = [0.0] * 8
    rows[12][1] = [float("nan")] + [0.5] * 7
    rows[13][1] = [float("inf")] + [0.5] * 7
    rows[14][1] = [1e-7] * 8
    rows[15][1] = [1e6] * 8
    return rows


TABLES = {
    "plain": plain_rows(120),
    "odd": odd_rows(300),
    "null ids": [*plain_rows(60), [None, [1.0] + [0.0] * 7, 1], [None, [0.0, 1.0] + [0.0] * 6, 2]],
    "ids that occur twice": [*plain_rows(60), *([i, v, (x + 1) % 4] for i, v, x in plain_rows(9, seed=2))],
    "all copies": [[i, [0.6, 0.8], i % 2] for i in range(70)],
    "few vectors": [[i, [0.6, 0.8] if i == 3 else None, i % 3] for i in range(9)],
    "one label": [[i, v, 1] for i, v, _ in plain_rows(20)],
    "one row": plain_rows(1),
}


def both(spark, tmp_path, name, rows):
    """The rows of a query and of its SQL on such a table of embeddings, sorted."""
    ids, values, labels = zip(*rows, strict=True)
    path = str(tmp_path / "embeddings.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    return sorted(map(tuple, got), key=str), sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("table", TABLES)
def test_nil_rejection_equals_its_sql(spark, tmp_path, table):
    got, want = both(spark, tmp_path, "a31_nil_rejection_sweep", TABLES[table])
    assert got == want


def test_nil_rejection_asks_all_rows(spark, tmp_path):
    got, _ = both(spark, tmp_path, "a31_nil_rejection_sweep", TABLES["plain"])
    assert [n for _, n, _ in got] == [120] * 4  # ids divisible by 50 are 3


@pytest.mark.parametrize("table", TABLES)
def test_recall_equals_its_sql(spark, tmp_path, table):
    got, want = both(spark, tmp_path, "a33_recall_at_k", TABLES[table])
    assert got == want


def test_recall_asks_all_rows(spark, tmp_path):
    """Ids divisible by 50 alone find their label, and the others never do."""
    rows = [[i, [float(i % 50 == 0), float(i % 50 != 0)], i % 50 and i] for i in range(200)]
    got, _ = both(spark, tmp_path, "a33_recall_at_k", rows)
    assert got == [(4 / 200, 4 / 200)]


@pytest.mark.parametrize("table", TABLES)
def test_nearest_equals_its_sql(spark, tmp_path, table):
    got, want = both(spark, tmp_path, "j16_m1_vector_top_k", TABLES[table])
    assert got == want


def test_nearest_asks_all_rows(spark, tmp_path):
    got, _ = both(spark, tmp_path, "j16_m1_vector_top_k", TABLES["plain"])
    assert sorted(q for q, _ in got) == [i for i in range(120) for _ in range(5)]


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("scale", ["one", "many", "few values", "some without end"])
def test_products_by_tiles_equal_all_products(monkeypatch, kind, scale):
    monkeypatch.setattr(vectors, "TILE_ROWS", 16)
    monkeypatch.setattr(vectors, "CELLS", 16 * 50)
    rng = np.random.default_rng(3)
    one, two = rng.normal(size=(40, 8)), rng.normal(size=(230, 8))
    if scale == "many":
        one, two = one * 10.0 ** rng.integers(-8, 6, size=(40, 1)), two * 10.0 ** rng.integers(-8, 6, size=(230, 1))
    if scale == "few values":
        one, two = np.sign(one) * (one > 0), np.sign(two)
    if scale == "some without end":
        one[3, 1], two[5, 2], two[60, 0], two[61, 1] = np.nan, np.inf, -np.inf, np.nan
    one, two = one.astype(kind), two.astype(kind)
    for many, own, others in ((False, np.arange(40), np.arange(230) % 115), (True, np.arange(40) % 3, np.arange(230) % 3)):
        found = {i: [] for i in range(40)}
        for rows, columns, products in vectors.closest(one, two, own, others, 4, many):
            for i, j, value in zip(rows, columns, products, strict=True):
                found[int(i)].append((int(j), str(value)))
        for i in range(40):
            value = vectors.picked_products(one, two, np.full(230, i), np.arange(230))
            order = sorted((j for j in range(230) if others[j] != own[i]), key=lambda j: (not np.isnan(value[j]), -value[j] if not np.isnan(value[j]) else 0, j))
            assert found[i] == [(j, str(value[j])) for j in order[:4]]


def test_vectors_of_zeros_make_few_products_again(monkeypatch):
    """All their products are equal; only those of the least ids are made again."""
    made, real = [], vectors.picked_products
    monkeypatch.setattr(vectors, "picked_products", lambda one, two, row, column: made.append(len(row)) or real(one, two, row, column))
    two = np.random.default_rng(4).normal(size=(9000, 8)).astype(np.float32)
    found = [np.concatenate(x) for x in zip(*vectors.closest(np.zeros((300, 8), np.float32), two, np.arange(300), np.arange(9000), 3, False), strict=True)]
    assert sum(made) < 20_000  # of 2.7 million
    assert found[1].reshape(300, 3)[:4].tolist() == [[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]]
