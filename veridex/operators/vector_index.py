"""An inverted file over vectors: every row is filed under its nearest centroid, and a query reads the lists nearest to it.

Centroids are fitted on a bounded sample, and so is the number of lists to read: the true neighbours of a few sampled rows,
found among all rows, tell how many lists reach the wanted share of them.  All rows are filed, whatever the sample was.
Equal vectors are one entry with the first ids that hold it, so copies are never paired with each other.  A list of many
rows is cut into blocks, so no task holds a whole one, and products are made piece by piece, so that what a task holds
depends neither on the rows nor on the lists; ``vectors.top_k`` is the exact way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.operators import rank
from veridex.operators.vectors import CELLS, matrix, top_products
from veridex.sources.shared import written

#: Bounds of what the driver and each task hold: centroids, sampled rows for each of them, and sampled queries.
MOST_LISTS = 4096
SAMPLE_PER_LIST = 64
PROBED_QUERIES = 256
#: Rows that a task passes on at once when it files rows under their lists.
FILED_ROWS = 1 << 14


@dataclass(frozen=True)
class Index:
    """Centroids as rows, and how many lists a query reads."""

    centroids: np.ndarray
    probes: int


def own_lists(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list of each row and its similarity, by pieces of CELLS products."""
    own, similar, step = np.empty(len(rows), np.int64), np.empty(len(rows)), max(1, CELLS // len(centroids))
    for begin in range(0, len(rows), step):
        piece = rows[begin : begin + step] @ centroids.T
        own[begin : begin + step] = piece.argmax(1)
        similar[begin : begin + step] = piece.max(1)
    return own, similar


def filed(centroids: np.ndarray, most: int) -> Callable:
    """Batches with a vector in their second column as rows of the most lists nearest to each, at most FILED_ROWS at once or
    one row's."""

    def run(batches):
        for batch in batches:
            own = matrix(batch.column(1))
            if not len(own):
                continue
            if own.shape[1] != centroids.shape[1]:  # of fit's single list of tiny tables
                own = np.zeros((len(own), centroids.shape[1]))
            for at, lists, _ in top_products(own, centroids, np.arange(len(centroids)), most, most=FILED_ROWS):
                picked = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int64)), *picked.columns], names=["list", *picked.schema.names])

    return run


def k_means(rows: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of rows by inner product; a list that loses all its rows takes the row farthest from its own."""
    rng = np.random.default_rng(seed)
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    centroids = unit[rng.choice(len(unit), lists, replace=False)]
    for _ in range(rounds):
        own, similar = own_lists(unit, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, unit)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        if len(empty):
            sums[empty] = unit[np.argsort(similar)[: len(empty)]]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def sampled(vectors: DataFrame, key: str, vector: str, concept: str | None, rows: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """At most rows vectors and their concepts, those with the least hashes of their keys."""
    share = min(1.0, 1.2 * rows / max(total, 1))
    bound = int(share * 1_000_000)
    hashed = F.pmod(F.xxhash64(F.lit(11), key), F.lit(1_000_000))
    found = vectors.filter(hashed <= bound).select(vector, F.col(concept or key).alias("c")).limit(rows).toArrow()
    return matrix(found.column(0)), found["c"].to_numpy()


def fit(vectors: DataFrame, key: str, vector: str, k: int, recall: float = 0.95, lists: int | None = None, concept: str | None = None) -> Index:
    """Centroids, about the square root of the rows in number but at most MOST_LISTS, and the lists to read for a recall.

    The recall is that of the k nearest of at most PROBED_QUERIES sampled rows, held against all rows; with a concept, of the nearest
    that haven't the row's own.
    """
    total = vectors.count()
    lists = min(lists or round(total**0.5), MOST_LISTS, total)
    if lists < 2:
        return Index(np.zeros((1, 1)), 1)
    rows, concepts = sampled(vectors, key, vector, concept, SAMPLE_PER_LIST * lists, total)
    centroids = k_means(rows, min(lists, len(rows)))
    queries, concepts = rows[:PROBED_QUERIES], concepts[:PROBED_QUERIES]

    def nearest(batches):
        """The k + 1 best rows of a batch for each sampled query, a query's own row among them, and their lists."""
        for batch in batches:
            own = matrix(batch.column(0))
            if not len(own):
                continue
            apart = (concepts, batch.column(1).to_numpy(zero_copy_only=False)) if concept else None
            for at, column, similar in top_products(queries, own, np.arange(len(own)), k + 1, apart):
                held = own_lists(own[column], centroids)[0]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(similar), pa.array(held)], names=["query", "similarity", "list"])

    found = vectors.select(vector, concept or key).mapInArrow(nearest, "query bigint, similarity double, list bigint")
    best = rank.top_per_group(found, ["query"], [F.col("similarity").desc(), F.col("list")], k + 1).toArrow()
    order = np.argsort(np.argsort(-(queries @ centroids.T), axis=1), axis=1)  # the place of each list for each query
    places = np.sort(order[best["query"].to_numpy(), best["list"].to_numpy()])
    return Index(centroids, int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1)


def top_k(index: Index, queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, concept: str | None = None, block: int = 8192) -> DataFrame:
    """(query, match, similarity, rn): the k most similar rows that each query's lists hold, ties by key, itself left out.

    queries are rows of vectors.  concept: a column; rows of the query's own concept are left out too.  Rows without a
    vector have no place and no result.
    """
    spark = vectors.sparkSession
    centroids, probes = index.centroids, min(index.probes, len(index.centroids))
    same = ["h1", "h2", "c"]

    def named(frame: DataFrame) -> DataFrame:
        held = frame.filter(F.col(vector).isNotNull())
        return held.select(F.col(key).alias("id"), F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(3), vector).alias("h2"), F.col(concept or key).cast("bigint").alias("c"), F.col(vector).alias("v"))

    rows = named(vectors).withColumn("c", F.col("c") if concept else F.lit(0).cast("bigint"))
    wanted = named(queries).withColumn("c", F.col("c") if concept else F.lit(0).cast("bigint")).drop("v")
    firsts = rank.top_per_group(rows.drop("v"), same, [F.col("id")], k + 1).groupBy(*same).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    firsts = written(firsts.withColumn("entry", F.get("ids", F.lit(0))))
    entries = rows.select("id", "v").join(firsts.select(F.col("entry").alias("id"), "ids", "c"), "id")
    asked = firsts.join(wanted.select(*same).distinct(), same, "left_semi").select("entry")
    asking = rows.select("id", "v", "c").join(asked.withColumnRenamed("entry", "id"), "id")

    kind, shape = vectors.schema[key].dataType.simpleString(), vectors.schema[vector].dataType.simpleString()
    listed = written(entries.select("id", "v", "ids", "c").mapInArrow(filed(centroids, 1), f"list bigint, id {kind}, v {shape}, ids array<{kind}>, c bigint"))
    probing = asking.select("id", "v", "c").mapInArrow(filed(centroids, probes), f"list bigint, id {kind}, v {shape}, c bigint")

    # a row a list, at most MOST_LISTS: into how many blocks the rows of a list and its queries are cut
    sizes = listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    asked_sizes = probing.groupBy("list").agg(F.count(F.lit(1)).alias("m"))
    parts = sizes.join(asked_sizes, "list").select("list", F.ceil(F.col("n") / block).alias("nb"), F.ceil(F.col("m") / block).alias("mb"))
    parts = F.broadcast(spark.createDataFrame(parts.toArrow().to_pylist(), "list bigint, nb bigint, mb bigint"))
    number = lambda name: F.pmod(F.xxhash64("id"), F.col(name))
    left = probing.join(parts, "list").withColumn("qb", number("mb")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb", "mb")
    right = listed.join(parts, "list").withColumn("vb", number("nb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).drop("nb", "mb")

    def product(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.table({"query": pa.array([], one.schema.field("id").type), "best": pa.array([], pa.float64()), "ids": pa.array([], two.schema.field("ids").type)})
        apart = (one["c"].to_numpy(), two["c"].to_numpy()) if concept else None
        parts = list(top_products(matrix(one["v"]), matrix(two["v"]), two["id"].to_numpy(), k + 1, apart))
        at, column, best = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"query": one["id"].take(pa.array(at)), "best": best, "ids": two["ids"].take(pa.array(column))})

    grouped = left.groupBy("list", "qb", "vb").cogroup(right.groupBy("list", "qb", "vb"))
    found = grouped.applyInArrow(product, f"query {kind}, best double, ids array<{kind}>")
    spread = found.select("query", F.round("best", 12).alias("similarity"), F.explode("ids").alias("match"))
    kept = rank.numbered(spread, ["query"], [F.col("similarity").desc(), F.col("match")]).filter(F.col("rn") <= k + 1)
    answers = kept.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rn", "match", "similarity"))).alias("all"))
    answers = written(answers)

    entry = firsts.select(*same, F.col("entry").alias("query"))
    whole = wanted.join(entry, same).join(answers, "query").select("id", F.slice(F.filter("all", lambda x: x["match"] != F.col("id")), 1, k).alias("all"))
    return whole.select(F.col("id").alias("query"), F.posexplode("all").alias("place", "one")).select("query", "one.match", "one.similarity", (F.col("place") + 1).cast("int").alias("rn"))
