"""Embedding whitening by hierarchical SVD merging.

Vectors become whole numbers, and each distinct one counts once.  A partition of them keeps its row count, its sums, its
mean and all singular values and right vectors of its centred rows; two partitions merge by stacking their scaled vectors
with one row for the difference of their means and decomposing again.  All dimensions are kept at each step, so a merge
loses nothing.  Partial results are of the size of one square matrix and merge in groups, level by level, until one is left.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridex.llm.shared_store import written

#: Beyond this doubles skip whole numbers.
EXACT = float(2**53)
FAN_IN = 16


def whole_numbers(entries: pa.ListArray, scale: int) -> list[np.ndarray | None]:
    """floor(scale * c) of each entry of each vector; None for a vector that is null or has an entry without such a number."""
    ends = entries.offsets.to_numpy()
    flat = entries.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(flat * scale)
        good = np.abs(scaled) < EXACT  # not for NaN and infinities
    whole = np.where(good, scaled, 0).astype(np.int64)
    bad = np.r_[0, np.cumsum(~good)]
    null = entries.is_null().to_numpy(zero_copy_only=False)
    pairs = zip(ends[:-1].tolist(), ends[1:].tolist(), null.tolist(), strict=True)
    return [None if gone or b == a or bad[b] > bad[a] else whole[a:b] for a, b, gone in pairs]


def packed(vector: np.ndarray) -> bytes:
    """The vector in the least of 2, 4 or 8 bytes an entry that holds all, so equal vectors are equal bytes."""
    most = int(np.abs(vector).max())
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return bytes([width]) + vector.astype(f"<i{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


class Part:
    """What a set of rows keeps: count, exact sums, mean, and the scaled right singular vectors of its centred rows."""

    def __init__(self, rows: np.ndarray):
        self.n, self.sums = len(rows), [int(s) for s in rows.sum(0, dtype=object)]
        self.mean = np.array([s / self.n for s in self.sums])
        self.axes = self._axes(rows - self.mean)

    @staticmethod
    def _axes(rows: np.ndarray) -> np.ndarray:
        _, values, vectors = np.linalg.svd(rows, full_matrices=False)
        return values[:, None] * vectors

    def merge(self, other: Part) -> Part:
        """Both sets as one: the difference of the means is one more row."""
        out = Part.__new__(Part)
        out.n, out.sums = self.n + other.n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        correction = np.sqrt(self.n * (other.n / out.n)) * (self.mean - other.mean)
        out.mean = np.array([s / out.n for s in out.sums])
        out.axes = self._axes(np.vstack([self.axes, other.axes, correction]))
        return out

    def components(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit components as rows, their eigenvalues, their shares of the trace), none without variance."""
        _, values, vectors = np.linalg.svd(self.axes, full_matrices=False)
        variance = values**2 / self.n
        scale = np.abs(self.mean).max(initial=0) + values.max(initial=0)
        rank = int((values > scale * max(self.axes.shape) * np.finfo(float).eps).sum())
        kept = min(most, rank)
        return vectors[:kept], variance[:kept], variance[:kept] / (variance.sum() or 1.0)


class Moments:
    """Count, mean and centred products of some columns, merged the same way."""

    def __init__(self, rows: np.ndarray):
        self.n, self.mean = len(rows), rows.mean(0)
        centred = rows - self.mean
        self.products = centred.T @ centred

    def merge(self, other: Moments) -> Moments:
        out = Moments.__new__(Moments)
        out.n = self.n + other.n
        gap = other.mean - self.mean
        out.mean = self.mean + gap * (other.n / out.n)
        out.products = self.products + other.products + np.outer(gap, gap) * (self.n * (other.n / out.n))
        return out


def _blocks(batches, most: int = 8192):
    """The vectors of Arrow batches as matrices of at most most rows."""
    for batch in batches:
        column = batch.column(0)
        for at in range(0, len(column), most):
            yield np.stack([unpacked(x) for x in column.slice(at, most).to_pylist()])


def summarised(vectors: DataFrame, kind: type, of=None) -> object | None:
    """One Part or Moments of all rows of (x binary): one a task, then merged in groups until one is left.

    What the driver gets is that one, of the size of a square matrix of the dimensions, whatever the rows.
    """

    def first(batches):
        yield from merged(kind(rows if of is None else of(rows)) for rows in _blocks(batches))

    def again(batches):
        yield from merged(pickle.loads(data) for batch in batches for data in batch.column(0).to_pylist())

    def merged(parts):
        whole = functools.reduce(lambda a, b: b if a is None else a.merge(b), parts, None)
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(whole)], pa.binary())], names=["part"])

    parts = written(vectors.select("x").mapInArrow(first, "part binary"))
    left = parts.count()
    while left > 1:
        groups = -(-left // FAN_IN)
        parts = written(parts.repartition(groups).mapInArrow(again, "part binary"))
        left = min(groups, parts.count())
    row = parts.first()
    return None if row is None else pickle.loads(row["part"])


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2, exact; None where 64 bits don't hold it."""
    total = np.array(sums, object)
    most = n * int(np.abs(rows).max(initial=0)) + max(map(abs, sums), default=0)
    exact = most * most * max(1, len(sums)) < 2**63
    gaps = n * (rows if exact else rows.astype(object)) - (total.astype(np.int64) if exact else total)
    return [s if s < 2**63 else None for s in (gaps * gaps).sum(1).tolist()]


def whiten(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """One row for each row of docs with a vector and each component: id_col, component (from 1, by falling variance), n,
    deviation, whitened, explained, identity_error.

    Left out: rows whose vector is null or empty, has a null or non-finite entry or one whose scale-fold is beyond 2^53, or
    isn't of the length that most distinct vectors have (the longest of equally frequent ones).  Components without
    variance can't be scaled to one and are left out too, so a table of one distinct vector gives no rows, as an empty one
    does.  A deviation beyond 64 bits is null.  Repeated rows and null ids give rows each, but a vector counts once in the
    fit however often it stands.  Other columns of docs are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("_vector"))

    def whole(batches):
        for batch in batches:
            found = [v for v in whole_numbers(batch.column(0), scale) if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([packed(v) for v in found], pa.binary()), pa.array([len(v) for v in found], pa.int32())], names=["x", "dims"])

    fit = written(source.select("_vector").mapInArrow(whole, "x binary, dims int").distinct())
    lengths = fit.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    kind = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]).add("component", "integer").add("n", "long").add("deviation", "long")
    kind = kind.add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if lengths is None:
        return spark.createDataFrame([], kind)
    dims = lengths["dims"]
    fit = fit.filter(F.col("dims") == dims)
    model = summarised(fit, Part)
    axes, variance, shares = model.components(components)
    n, sums, mean = model.n, model.sums, model.mean

    def projected(rows):
        return ((rows - mean) @ axes.T) / np.sqrt(variance)

    moments = summarised(fit, Moments, projected)
    error = float(np.abs(moments.products / n - np.eye(len(axes))).max(initial=0.0))
    count = len(axes)

    def run(batches):
        for batch in batches:
            found = whole_numbers(batch.column(1), scale)
            kept = [i for i, v in enumerate(found) if v is not None and len(v) == dims]
            if not kept or not count:
                continue
            rows = np.stack([found[i] for i in kept])
            places = np.repeat(np.array(kept), count)
            deviation = pa.array(deviations(rows, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(kept)), count)))
            columns = [
                batch.column(0).take(pa.array(places)),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(kept))),
                pa.array(np.full(len(places), n, np.int64)),
                deviation,
                pa.array(projected(rows).reshape(-1)),
                pa.array(np.tile(shares, len(kept))),
                pa.array(np.full(len(places), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return source.mapInArrow(run, kind)
