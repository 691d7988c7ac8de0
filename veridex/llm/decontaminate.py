"""Benchmark decontamination by winnowing.

With k-grams of k words and windows of w k-grams, each run of k + w - 1 = ``span`` words keeps the smallest k-gram hash
of its window, in documents and benchmark items alike, so two texts that share a run of that many words share a kept
fingerprint in it.  Documents' fingerprints first pass a bit filter of fixed size built from the benchmark's; what is
left is joined with the benchmark's fingerprints by a shuffle, and each hit is extended by up to span - k words to
either side, which covers each shared run that holds the fingerprint.  Items of fewer than ``span`` words are a run of
their own length n, winnowed with k = n and w = 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm import wordhash
from veridex.llm.arrowtext import lower_ascii, pieces, utf8

#: Bits of the filter; its size doesn't depend on the benchmark, only how much it lets through.
FILTER_BITS = 23
HIT = "struct<h:bigint,n:int,pos:int,around:array<bigint>>"


def winnow(words: np.ndarray, first: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the kept k-grams of all texts whose words are in a row; first: each text's first word."""
    grams, w = wordhash.grams(words, k), span - k + 1
    places = len(words) - span + 1
    if places <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = grams[:places].copy()
    for j in range(1, w):
        np.minimum(low, grams[j : j + places], out=low)
    whole = text[:places] == text[span - 1 :]
    low[~whole] = 0  # a window over two texts selects nothing
    high = np.zeros(len(grams), np.uint64)
    for j in range(w):
        np.maximum(high[j : j + places], low, out=high[j : j + places])
    kept = np.flatnonzero((grams == high) & (high > 0))
    return kept, grams[kept]


def short_runs(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of n words that lie in one text."""
    grams = wordhash.grams(words, n)
    if not len(grams):
        return np.empty(0, np.int64), grams
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    kept = np.flatnonzero(text[: len(grams)] == text[n - 1 :])
    return kept, grams[kept]


def around(words: np.ndarray, first: np.ndarray, at: np.ndarray, k: int, reach: int, absent: int) -> np.ndarray:
    """For each place the hashes of the words before and after its k words, nearest first; absent beyond the text."""
    text = np.searchsorted(first, at, side="right") - 1
    step = np.arange(1, reach + 1)
    left, right = at[:, None] - step, at[:, None] + (k - 1) + step
    out = np.full((len(at), 2 * reach), absent, np.int64)
    signed = words.view(np.int64)
    for cols, where, ok in ((slice(0, reach), left, left >= first[text][:, None]), (slice(reach, None), right, right < first[text + 1][:, None])):
        part = out[:, cols]
        part[ok] = signed[where[ok]]
    return out


def bits(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of the filter for each hash."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (hashed & mask).astype(np.int64), ((hashed >> np.uint64(FILTER_BITS)) & mask).astype(np.int64)


def fingerprints(texts: pa.Array, k: int, span: int, short: tuple[int, ...], keep, absent: int):
    """(first, per text the places, hashes, run lengths and surroundings of kept fingerprints), one flat row each."""
    raw, ends = utf8(texts)
    raw = lower_ascii(raw)
    starts, stops, first = wordhash.spans(raw, ends, wordhash.table("alnum"))
    words = wordhash.hashes(raw, starts, stops)
    reach = span - k
    found = []
    for n in (span, *short):
        at, hashed = winnow(words, first, k, span) if n == span else short_runs(words, first, n)
        ok = keep(hashed, n, at)
        at, hashed = at[ok], hashed[ok]
        near = around(words, first, at, k, reach, absent) if n == span else np.zeros((len(at), 2 * reach), np.int64)
        found.append((at, hashed, np.full(len(at), n, np.int32), near))
    at, hashed, n, near = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    return first, at[order], hashed[order], n[order], near[order]


def as_hits(first: np.ndarray, at: np.ndarray, hashed: np.ndarray, n: np.ndarray, near: np.ndarray) -> pa.Array:
    """The fingerprints as one list of structs a text."""
    text = np.searchsorted(first, at, side="right") - 1
    width = near.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(near.ravel()))
    rows = pa.StructArray.from_arrays(
        [pa.array(hashed.view(np.int64)), pa.array(n), pa.array((at - first[text]).astype(np.int32)), lists], ["h", "n", "pos", "around"]
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first), pa.int32()), rows)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = 10,
    k: int = 5,
) -> DataFrame:
    """One row for each document: id_col, n_words, n_hit, items (array<string>, sorted), spans (array of [start, end) in
    words, sorted), contaminated.

    Words are runs of digits, letters and characters above ASCII, with A-Z lower-cased.  A window is ``span`` words of an
    item in a row, or the whole item if it has fewer, but not none; a document word inside any occurrence of a window is
    hit.  A null text has no words.  Rows that share id and text are one document and give one row; rows that share only
    the id give a row each; a null id is an id.  Items with a null id are left out, and items that share an id are one
    item with several texts.  An empty table of documents gives no rows, an empty benchmark none that are contaminated.
    Other columns are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    reach = span - k
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("_item"), F.col(item_text_col).cast("string").alias("_text"))

    def item_prints(batches):
        for piece in pieces(batches, 1):
            raw, ends = utf8(piece.column(1))
            sizes = np.diff(wordhash.spans(lower_ascii(raw), ends, wordhash.table("alnum"))[2])
            lengths = tuple(sorted({int(n) for n in sizes if 0 < n < span}))

            def own(hashed, n, at, first=np.concatenate([[0], np.cumsum(sizes)]), sizes=sizes):
                return np.ones(len(at), bool) if n == span else sizes[np.searchsorted(first, at, side="right") - 1] == n

            first, *rest = fingerprints(piece.column(1), k, span, lengths, own, -1)
            yield pa.RecordBatch.from_arrays([piece.column(0), as_hits(first, *rest)], names=["item", "hits"])

    prints = items.mapInArrow(item_prints, f"item string, hits array<{HIT}>").select("item", F.inline("hits"))
    prints = prints.select("item", "h", "n", F.col("around").alias("item_around")).distinct()

    # at most 2 ** FILTER_BITS / 32 rows, whatever the benchmark holds
    low = F.array(F.col("h"), F.shiftrightunsigned("h", FILTER_BITS))
    place = prints.select("n", F.explode(F.transform(low, lambda x: x.bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("bigint")))).alias("p"))
    packed = place.groupBy(F.shiftright("p", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("word"), F.collect_set("n").alias("ns"))
    words = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    lengths: set[int] = set()
    for row in packed.collect():
        words[row["at"]] = row["word"]
        lengths.update(row["ns"])
    short = tuple(sorted(n for n in lengths if n < span))
    known = spark.sparkContext.broadcast(np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool).tobytes())

    def doc_prints(batches):
        member = np.frombuffer(known.value, bool)

        def seen(hashed, n, at):
            a, b = bits(hashed)
            return member[a] & member[b]

        for piece in pieces(batches, 2):
            first, *rest = fingerprints(piece.column(2), k, span, short, seen, -2)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(np.diff(first)), as_hits(first, *rest)], names=["id", "row", "n_words", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    source = source.select("id", F.xxhash64("_text").alias("row"), "_text")
    found = source.mapInArrow(doc_prints, f"id {kind}, row bigint, n_words bigint, hits array<{HIT}>")

    # a document without hits keeps one row, dealt by its own hash so that such rows don't meet in one task
    hits = found.select("id", "row", "n_words", F.inline_outer("hits"))
    hits = hits.withColumn("key", F.coalesce("h", F.xxhash64("id", "row"))).withColumn("n", F.coalesce("n", F.lit(0)))
    joined = hits.join(prints.withColumnRenamed("h", "key"), ["key", "n"], "left")
    joined = joined.select("id", "row", "n_words", "n", "pos", "around", "item", "item_around")

    def extend(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            hit = table.filter(pc.is_valid(table["item"])).combine_chunks()
            n, pos = (hit[c].to_numpy().astype(np.int64) for c in ("n", "pos"))
            mine, theirs = (hit[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(n), 2 * reach) for c in ("around", "item_around"))
            same = mine == theirs
            left, right = (np.cumprod(part, axis=1).sum(axis=1) for part in (same[:, :reach], same[:, reach:]))
            start = np.where(n == span, pos - left, pos)
            end = np.where(n == span, pos + k + right, pos + n)
            ok = end - start >= n
            ends = pa.StructArray.from_arrays([pa.array(start[ok].astype(np.int32)), pa.array(end[ok].astype(np.int32))], ["start", "end"])
            yield from hit.filter(pa.array(ok)).select(base + ["item"]).append_column("span", ends).to_batches()
            # whatever becomes of its hits, a document keeps a row
            rest = table.select(base).group_by(base).aggregate([]) if len(hit) else table.select(base)
            rest = rest.append_column("item", pa.nulls(len(rest), pa.string())).append_column("span", pa.nulls(len(rest), ends.type))
            yield from rest.to_batches()

    base = ["id", "row", "n_words"]
    spans = joined.mapInArrow(extend, f"id {kind}, row bigint, n_words bigint, item string, span struct<start:int,end:int>")
    grouped = spans.groupBy("id", "row").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set("span")).alias("spans")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))))
    return grouped.select(
        F.col("id").alias(id_col), "n_words", covered.cast("bigint").alias("n_hit"), "items", "spans", (F.size("spans") > 0).alias("contaminated")
    )
