"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of at most 23 bits.  The Golay code of length 23 puts each word
within three bits of one codeword; a segment's keys are that codeword and, if it is three bits away, the five codewords
four bits away.  Two segments that differ in at most two bits share a key.  Four differing bits over three segments
leave two segments with at most two each (pigeonhole), so linked fingerprints share the key of a pair of segments,
24 bits long.  Distinct fingerprints meet by that key and are verified by their differing bits.  Of a group only the
smallest member's edges to the others are passed on, never all pairs; exact copies are one fingerprint from the start.
A key with more than ``block`` fingerprints is cut into blocks, and the pairs of blocks are dealt out as groups again.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.arrowtext import pieces, utf8
from veridex.llm.components import components
from veridex.llm.shared_store import written

#: The generator polynomial of the Golay code, and the widths of the segments.
GENERATOR = 0xC75
SEGMENTS = (22, 21, 21)


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def key_errors() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the patterns that lead to the codewords of its keys, and how many there are (1 or 6)."""
    patterns = {w: np.array([sum(1 << b for b in c) for c in combinations(range(23), w)], np.int64) for w in range(5)}
    table, count = np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    for w in range(4):
        table[syndromes(patterns[w]), 0] = patterns[w]
    far = set(syndromes(patterns[3]).tolist())
    for syndrome, pattern in zip(syndromes(patterns[4]).tolist(), patterns[4].tolist(), strict=True):
        if syndrome in far:
            table[syndrome, count[syndrome]] = pattern
            count[syndrome] += 1
    return table, count


_TABLES: list = []


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, valid) of each segment: six columns of 12-bit indices of codewords."""
    if not _TABLES:
        _TABLES.append(key_errors())
    table, count = _TABLES[0]
    syndrome = syndromes(segment)
    return (segment[:, None] ^ table[syndrome]) >> 11, np.arange(6) < count[syndrome][:, None]


def pair_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the fingerprint, key) for each pair of segments and each pair of their keys."""
    segments, low = [], 0
    for width in SEGMENTS:
        segments.append(golay_keys((prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)))
        low += width
    rows, keys = [], []
    for number, (a, b) in enumerate(combinations(range(3), 2)):
        (ka, oka), (kb, okb) = segments[a], segments[b]
        both = (oka[:, :, None] & okb[:, None, :]).reshape(len(prints), 36)
        code = ((ka[:, :, None] << 12 | kb[:, None, :]) | number << 24).reshape(len(prints), 36)
        row, _ = np.nonzero(both)
        rows.append(row)
        keys.append(code[both])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint_texts(texts: pa.Array, width: int = 4, seed: int = 42) -> np.ndarray:
    """SimHash of each text over its shingles of width words."""
    from xxhash import xxh64_intdigest

    raw, ends = utf8(texts)
    lowered, out = raw.tobytes().lower(), np.zeros(len(texts), np.uint64)  # bytes: A-Z alone change, split() at blanks
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for number, (begin, end) in enumerate(zip(ends, ends[1:], strict=False)):
        words = lowered[begin:end].split()
        if not words:
            continue
        joined = b" ".join(words)
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.concatenate([[0], stop[:-1] + 1])
        n = min(width, len(words))
        places = zip(start[: len(words) - n + 1].tolist(), stop[n - 1 :].tolist(), strict=True)
        ones, count = np.zeros(64, np.int64), len(words) - n + 1
        hashed = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in places), np.uint64, count)
        for at in range(0, count, 1 << 16):
            bits = np.unpackbits(hashed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[number] = weights[2 * ones > count].sum(dtype=np.uint64)
    return out


def linked(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def forest(prints: np.ndarray, most: int) -> np.ndarray:
    """For each fingerprint of a group the place of the first one it is connected to inside the group.

    Breadth first: each step compares one fingerprint with those not reached yet, so a dense group takes few steps.
    """
    label = np.arange(len(prints))
    left = np.arange(len(prints))
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = linked(prints[left], prints[queue.pop()], most)
            reached, left = left[near], left[~near]
            label[reached] = root
            queue.extend(reached.tolist())
    return label


def group_edges(keys: np.ndarray, prints: np.ndarray, most: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger, smaller) that connect what is linked inside each group; keys are sorted, prints within them."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    first = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    label = np.arange(len(keys))
    for begin, size in zip(first[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        label[begin : begin + size] = begin + forest(prints[begin : begin + size], most)
    few = np.repeat(sizes <= small, sizes)
    one, two = [], []
    for lag in range(1, min(small, int(sizes.max(initial=1)))):
        near = (keys[lag:] == keys[:-lag]) & few[lag:]
        at = np.flatnonzero(near)
        at = at[linked(prints[at], prints[at + lag], most)]
        one.append(at)
        two.append(at + lag)
    if one:
        i, j = np.concatenate(one), np.concatenate(two)
        while len(i):
            before = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if np.array_equal(before, label):
                break
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return prints[moved], prints[label[moved]]


EDGE = "u bigint, v bigint, key int, block int"


def _edge_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(u), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), none, none], names=["u", "v", "key", "block"])


def _sorted_groups(batches, most: int, block: int):
    """Edges of groups that arrive sorted by key; a group of more than block rows goes on as blocks for the next step."""
    keys, prints, blocks = np.empty(0, np.int64), np.empty(0, np.uint64), {}

    def hot(key: int, some: np.ndarray) -> pa.RecordBatch:
        number = blocks[key] = blocks.get(key, -1) + 1
        n = len(some)
        return pa.RecordBatch.from_arrays(
            [pa.array(some.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.full(n, key, np.int32)), pa.array(np.full(n, number, np.int32))], names=["u", "v", "key", "block"]
        )

    for batch in chain(batches, [None]):  # None: the end
        if batch is not None:
            keys = np.concatenate([keys, batch.column(0).to_numpy().astype(np.int64)])
            prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        whole = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
        if whole:
            if (key := int(keys[0])) in blocks:  # the rest of a group that already went on in blocks
                n = int(np.searchsorted(keys[:whole], key, side="right"))
                yield _edge_batch(*group_edges(keys[:n], prints[:n], most))
                yield hot(key, prints[:n])
                keys, prints, whole = keys[n:], prints[n:], whole - n
            blocks.clear()
            if whole:
                yield _edge_batch(*group_edges(keys[:whole], prints[:whole], most))
            keys, prints = keys[whole:], prints[whole:]
        while len(keys) > block:  # one group so far
            yield _edge_batch(*group_edges(keys[:block], prints[:block], most))
            yield hot(int(keys[0]), prints[:block])
            keys, prints = keys[block:], prints[block:]


def near_links(prints: DataFrame, most: int = 4, block: int = 16_384) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp, bigint) that connect all those within most bits.

    most: up to 4, which the keys guarantee.
    """
    spark = prints.sparkSession
    if not 0 <= most <= 4:
        raise ValueError("the keys guarantee links of up to 4 differing bits")

    def keyed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                some = batch.column(0).slice(at, 8192).to_numpy().view(np.uint64)
                row, key = pair_keys(some)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(some[row].view(np.int64))], names=["key", "fp"])

    def grouped(batches):
        yield from _sorted_groups(batches, most, block)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # each fingerprint becomes some 80 rows
    rows = prints.select("fp").repartition(tasks).mapInArrow(keyed, "key int, fp bigint").repartition("key").sortWithinPartitions("key", "fp")
    found = written(rows.mapInArrow(grouped, EDGE))
    edges = found.filter("key IS NULL").select("u", "v")
    hot = found.filter("key IS NOT NULL").select("key", "block", F.col("u").alias("fp"))
    if hot.isEmpty():
        return edges

    count = hot.groupBy("key").agg((F.max("block") + 1).alias("n"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    pairs = hot.join(count, "key").select("key", "block", "fp", other).filter("block <> other")
    pairs = pairs.select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") > F.col("other")).alias("second"), "fp")

    def across(key, table):
        one = table.filter(pc.invert(table["second"]))["fp"].to_numpy().view(np.uint64)
        two = table.filter(table["second"])["fp"].to_numpy().view(np.uint64)
        both = np.sort(np.concatenate([one, two]))
        label = forest(both, most)
        moved = np.flatnonzero(label != np.arange(len(both)))
        return pa.table({"u": both[moved].view(np.int64), "v": both[label[moved]].view(np.int64)})

    return edges.union(pairs.groupBy("key", "a", "b").applyInArrow(across, "u bigint, v bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most: int = 4) -> DataFrame:
    """One row for each row of docs: id_col, fp (bigint, the 64 bits), component (the smallest id reachable by links).

    A text with fewer than width words has one shingle, its words; a null or blank text has the fingerprint 0, which
    links like any other.  Repeated rows and null ids give a row each; a null id is never the smallest unless all are.
    An empty table gives no rows.  Other columns of docs are not read, so their names can't clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def hashed(batches):
        for piece in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fingerprint_texts(piece.column(1), width).view(np.int64))], names=["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = written(source.mapInArrow(hashed, f"id {kind}, fp bigint"))
    distinct = marked.groupBy("fp").agg(F.min("id").alias("least"))
    star = components(near_links(distinct, most))

    rooted = distinct.join(star, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component")))  # so that Spark can split a hot root
    classes = rooted.join(named, "root").select("fp", "component")
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component")
