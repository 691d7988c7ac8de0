"""Exact substring dedup with suffix arrays.

Sharding by content keeps the work linear.  Anchors are chosen by winnowing (the smallest hash of a few bytes in each
window), so that each string of ``length`` bytes holds one at the same place as its other occurrences.  Such a string
also holds the half-reach before or after its anchor, and so one of two cores: the anchor with the bytes before it, or
with those after it.  Occurrences of a string meet under its core.  Cores that one place alone has are done, and so are
those whose places all have the same surroundings (all strings that can hold the core): these repeat as a whole.  For
the others each distinct surrounding goes to the core's shard once, with the core as one symbol of its own.

A shard is a string of surroundings and separators, or a few such strings with the cores dealt over them.  Its suffix
array is built by Larsson-Sadakane refinement: suffixes sorted by a few symbols, then only groups still tied are sorted
again by the rank of what follows, at twice the depth each time.  The last round sorts to exactly ``length`` bytes, so that
suffixes of one rank are those that share them; suffixes with less left than a round looks at leave before it.  A class at
two different places of the corpus marks its bytes.  A key with more surroundings than a shard holds is cut into blocks,
and pairs of blocks are merged by binary search of one's classes in the other's.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm import wordhash
from veridex.llm.arrowtext import pieces, utf8
from veridex.llm.shared_store import written

GRAM = 48
#: Grams that repeat this many bytes of themselves after up to GRAM - PART bytes are chosen only where there are no others.
PART = 16
SEPARATOR = 256
#: One in so many documents is looked at to lay out the places of keys, and a key with more than this part of a task's
#: share is dealt over several tasks.  Neither changes a result.
LOOK = 64
SPREAD = 4
#: The cores of a shard are dealt over strings of about so many bytes, whose arrays stay in a processor's cache.
CACHED = 1 << 17


def anchors(raw: np.ndarray, ends: np.ndarray, length: int, total: np.ndarray) -> np.ndarray:
    """Starts of the chosen GRAM-byte grams of all texts in the buffer, whose hash sums are total; ties choose all.

    The choice in a window depends on the window's bytes alone."""
    window = length - GRAM + 1
    n = len(raw) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    _, down = wordhash.powers(len(raw))

    def rolled(size: int) -> np.ndarray:
        hashes = total[size:] - total[:-size]
        hashes *= down[: len(hashes)]
        return hashes

    gram = wordhash.mix(rolled(GRAM))
    part = (rolled(PART) >> np.uint64(48)).astype(np.uint16)  # a chance hit is one gram chosen less
    periodic = np.zeros(len(gram), bool)
    for lag in range(1, GRAM - PART + 1):
        periodic |= part[: len(gram)] == part[lag : lag + len(gram)]
    gram = (gram >> np.uint64(33)).astype(np.uint32) | periodic.astype(np.uint32) << np.uint32(31) | np.uint32(1)  # 0 is none

    def slide(x: np.ndarray, least: bool) -> np.ndarray:
        """Minima or maxima of all windows, by doubling."""
        pick, width = (np.minimum if least else np.maximum), 1
        while width * 2 <= window:
            x = pick(x[:-width], x[width:])
            width *= 2
        rest = window - width
        return pick(x[: len(x) - rest], x[rest:]) if rest else x

    low = slide(gram, True)
    whole = np.ones(n, bool)
    for cut in ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(raw))].tolist():
        whole[max(0, cut - length + 1) : min(n, cut)] = False  # strings over two texts choose nothing
    low[~whole] = 0
    padded = np.zeros(n + 2 * (window - 1), np.uint32)
    padded[window - 1 : window - 1 + n] = low
    return np.flatnonzero(gram == slide(padded, False))


def digest(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int, total: np.ndarray) -> np.ndarray:
    """64 bits of each span."""
    return (wordhash.hashes(raw, begin, end, total) * np.uint64(2 * salt + 1)).view(np.int64)


def suffix_array(symbols: np.ndarray, most: int | None = None, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of a sequence of symbols.

    With most, suffixes are sorted by that many symbols, and those that share them all have one rank.  With left, which
    says how many symbols count from each position on, only positions with most of them are in the array, and the others'
    ranks mean nothing.
    """
    n = len(symbols)
    most = max(n, 1) if most is None else most
    wide, bits = n.bit_length(), (int(symbols.max(initial=0)) + 1).bit_length()
    gain = min(max(1, (63 - wide) // bits), most)
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(gain, np.int64)])
    key = padded[:n].copy()
    for j in range(1, gain):
        key <<= bits
        key |= padded[j : j + n]
    where = np.arange(n)
    rank = np.zeros(n + 1, np.int32 if wide < 32 else np.int64)  # the last: of nothing
    rank[n] = -1
    depth, low, high = gain, gain * bits, 0
    while len(where):
        key, where = _ordered(key, where, low + high, wide)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        cuts = np.flatnonzero(new)
        group = key[cuts] >> low
        opens = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        # a group's rank is the number of suffixes before it
        before = group + cuts - np.repeat(cuts[opens], np.diff(np.append(opens, len(cuts))))
        rank[where] = np.repeat(before.astype(rank.dtype), np.diff(np.append(cuts, len(where))))
        if depth >= most:
            break
        gain = min(depth, most - depth)
        depth += gain
        where = where[_in_group(new)]
        if left is not None:
            where = where[left[where] >= depth]
        key, low, high = rank[where].astype(np.int64), wide, wide
        key <<= wide
        key |= rank[np.minimum(where + gain, n)] + 1
    rank = rank[:n]
    at = np.arange(n) if left is None else np.flatnonzero(left >= most)
    return _ordered(rank[at].astype(np.int64), at, wide, wide)[1], rank


def _ordered(key: np.ndarray, where: np.ndarray, bits: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits in order, with their positions of at most wide bits: as one number of both where that fits."""
    if bits + wide <= 63:
        both = key << wide
        both |= where
        both.sort()
        return both >> wide, both & ((1 << wide) - 1)
    by = np.argsort(key)
    return key[by], where[by]


def _in_group(starts: np.ndarray) -> np.ndarray:
    """Which elements share their group with another; a group begins at each start."""
    return ~(starts & np.concatenate([starts[1:], [True]]))


def common_prefixes(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, first: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Kasai: for each position of the string what it shares with the suffix before it in the array, up to most.

    The value at a position is at least that of the position before, less one.  All pieces (first, size) go along at once.
    The classes come from the ranks alone; tests hold them against these prefixes.
    """
    n = len(symbols)
    before = np.concatenate([[-1], order[:-1]])[rank]
    out = np.zeros(n, np.int64)
    far = np.concatenate([symbols, np.full(most + 1, -1, symbols.dtype)])
    carried = np.zeros(len(first), np.int64)
    for t in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > t)
        at = first[live] + t
        have = np.maximum(carried[live] - 1, 0)
        other = before[at]
        have[other < 0] = 0
        grow = np.flatnonzero((other >= 0) & (have < most))
        while len(grow):
            a, b = at[grow] + have[grow], other[grow] + have[grow]
            same = (far[a] == far[b]) & (far[a] != SEPARATOR) & (b < n)
            grow = grow[same]
            have[grow] += 1
            grow = grow[have[grow] < most]
        out[at] = have
        carried[live] = have
    return out


class Shard:
    """Surroundings joined into one string, with the place in the corpus of each of its starts.

    data: the bytes before and after the core; before: how many stand before it; core: the core's number in the shard;
    place: of the first byte; many: there are others like it.  A string of the wanted length has ``width`` symbols.
    """

    def __init__(self, data: list[bytes], before: np.ndarray, core: np.ndarray, place: np.ndarray, many: np.ndarray, width: int):
        self.width, self.many, self.before = width, many, before
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        plain = np.frombuffer(b"\0".join([*data, b""]), np.uint8).astype(np.int32)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[: len(data)]
        plain[begin + sizes] = SEPARATOR
        self.symbols = np.insert(plain, begin + before, core + SEPARATOR + 1)
        self.size = sizes + 1
        self.first = begin + np.arange(len(data))
        self.place = np.repeat(place - self.first, self.size + 1) + np.arange(len(self.symbols))

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the order of the suffix array, number of the class of each) where width symbols are left."""
        left = np.repeat(self.first + self.size, self.size + 1) - np.arange(len(self.symbols))
        order, rank = suffix_array(self.symbols, self.width, left)
        return order, rank[order]

    def repeated(self) -> np.ndarray:
        """Whether the string of width symbols that starts at each position stands at two places of the corpus."""
        at, group = self.classes()
        out = np.zeros(len(self.symbols), bool)
        if len(at):
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            place = self.place[at]
            low, high = np.minimum.reduceat(place, cuts), np.maximum.reduceat(place, cuts)
            many = np.logical_or.reduceat(np.repeat(self.many, self.size + 1)[at], cuts)
            out[at] = np.repeat((low != high) | many, np.diff(np.concatenate([cuts, [len(at)]])))
        return out

    def heads(self) -> tuple[np.ndarray, ...]:
        """(sorted strings of the classes, first and last place of each, positions in the array's order, class of each)."""
        at, group = self.classes()
        if not len(at):
            return np.empty(0, "S1"), at, at, at, at
        new = np.concatenate([[True], group[1:] != group[:-1]])
        cuts, place = np.flatnonzero(new), self.place[at]
        strings = np.lib.stride_tricks.sliding_window_view(self.symbols.astype(">u4"), self.width)[at[cuts]]
        strings = np.ascontiguousarray(strings).view(f"S{4 * self.width}").ravel()
        return strings, np.minimum.reduceat(place, cuts), np.maximum.reduceat(place, cuts), at, np.cumsum(new) - 1


def merged(one: Shard, two: Shard) -> tuple[np.ndarray, np.ndarray]:
    """What each of two shards repeats of the other, by binary search among the other's sorted classes."""
    (a, low_a, high_a, at_a, group_a), (b, low_b, high_b, at_b, group_b) = one.heads(), two.heads()
    out_a, out_b = np.zeros(len(one.symbols), bool), np.zeros(len(two.symbols), bool)
    if len(a) and len(b):
        near = np.minimum(np.searchsorted(b, a), len(b) - 1)
        in_a = (b[near] == a) & (np.minimum(low_a, low_b[near]) != np.maximum(high_a, high_b[near]))
        in_b = np.zeros(len(b), bool)
        in_b[near[in_a]] = True
        out_a[at_a] = in_a[group_a]
        out_b[at_b] = in_b[group_b]
    return out_a, out_b


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _found(shard: Shard, starts: np.ndarray, ctx: np.ndarray, length: int) -> pa.Table:
    """(ctx, low, high) of the bytes that runs of starts cover, counted from the core."""
    begin, end = runs(starts)
    piece = np.searchsorted(shard.first, begin, side="right") - 1
    origin = shard.first[piece] + shard.before[piece]
    return pa.table({"ctx": ctx[piece], "low": (begin - origin).astype(np.int32), "high": (end - 1 + length - origin).astype(np.int32)})


def _shards(tables: list[pa.Table], width: int) -> list[tuple[Shard, np.ndarray]]:
    """A shard and its surroundings' digests for each table; places and cores are numbered alike in all."""
    both = pa.concat_tables(tables)
    local = np.unique(both["row"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    core = np.unique(both["key"].to_numpy(), return_inverse=True)[1].astype(np.int32)
    before = both["before"].to_numpy().astype(np.int64)
    place = (local << 40) + both["pos"].to_numpy() - before
    out, low = [], 0
    for table in tables:
        own = slice(low, low + len(table))
        low += len(table)
        shard = Shard(table["bytes"].to_pylist(), before[own], core[own], place[own], table["many"].to_numpy(), width)
        out.append((shard, table["ctx"].to_numpy()))
    return out


def packed_texts(source: DataFrame, kind: str) -> DataFrame:
    """(id, row, data): texts compressed on their way through a shuffle, half of what Spark's codec leaves of them."""

    def pack(batches):
        for batch in batches:
            for piece in pieces([batch], 1):
                data = [zlib.compress(text.encode(), 1) for text in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(data, pa.binary())], names=["id", "row", "data"])

    return source.select("id", "text", "row").mapInArrow(pack, f"id {kind}, row bigint, data binary")


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, shard_bytes: int = 1 << 20, block: int = 8192
) -> DataFrame:
    """One row for each document: id_col, n_bytes, n_removed, n_spans, kept (binary: the bytes left), kept_sha256.

    A byte goes if a string of length bytes covers it that also starts anywhere else in any text, the same one included;
    strings are judged on the input.  length: from GRAM + 2 to 30,000.  Places whose core and surroundings have equal
    64-bit hashes each are taken for equal.

    A null text is empty.  Each row is a document: a text in two rows, of one id or two, loses all its bytes in both, if it
    has length bytes.  A null id is an id; an empty table gives no rows.  Other columns of docs are not read, so their
    names can't clash.
    """
    if not GRAM + 2 <= length <= 30_000:
        raise ValueError(f"length must be from {GRAM + 2} to 30000")
    half = (length - GRAM) // 2
    core = length - half
    width = half + 1
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("row", F.xxhash64("id", "text"))
    spark = docs.sparkSession

    def anchored(batches):
        for piece in pieces(batches, 0, 1 << 19):
            raw, ends = utf8(piece.column(0))
            total = wordhash.sums(raw)
            at = anchors(raw, ends, length, total)
            text = np.searchsorted(ends, at, side="right") - 1
            mid, text = np.concatenate([at - half, at]), np.concatenate([text, text])
            ok = (mid >= ends[text]) & (mid + core <= ends[text + 1])
            mid, chosen = np.unique(mid[ok], return_index=True)  # two anchors may share a core
            text = text[ok][chosen]
            begin, end = ends[text], ends[text + 1]
            left, right = np.maximum(mid - half, begin), np.minimum(mid + length, end)
            key = digest(raw, mid, mid + core, 2, total)
            ctx = digest(raw, left, right, 1, total) ^ digest(raw, left, mid, 7, total)
            span = (mid - left) << 16 | right - mid
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(ctx), pa.array(piece.column(1).to_numpy()[text]), pa.array((mid - begin).astype(np.int32)), pa.array(span.astype(np.int32))],
                names=["key", "ctx", "row", "pos", "span"],
            )

    layout = "key bigint, ctx bigint, row bigint, pos int, span int"
    found = source.select("text", "row").mapInArrow(anchored, layout)

    # A key's places stand together in one task, by its leading bits.  Keys of many places fill several tasks; which keys
    # that are is read off a look at some documents.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    look = source.filter(F.pmod(F.xxhash64("row"), F.lit(LOOK)) == 0).select("text", "row").mapInArrow(anchored, layout).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    looked = look.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = F.least(F.ceil(F.col("n") * (SPREAD * tasks / max(1, looked))).cast("int"), F.lit(tasks))
    heavy = look.filter(F.col("n") >= max(8, looked / (SPREAD * tasks))).select("key", parts.alias("parts")).collect()  # SPREAD * tasks rows at most
    plain_task = F.shiftright(F.shiftrightunsigned("key", 33) * F.lit(tasks).cast("bigint"), 31).cast("int")
    if heavy:
        known = F.broadcast(spark.createDataFrame(heavy, "key bigint, parts int"))
        spread = F.pmod(F.xxhash64("key") + F.pmod(F.xxhash64("ctx", "row", "pos"), "parts"), F.lit(tasks)).cast("int")
        found = found.join(known, "key", "left").withColumn("task", F.when(F.col("parts").isNull(), plain_task).otherwise(spread))
        found = found.select("key", "ctx", "row", "pos", "span", F.col("parts").isNotNull().alias("heavy"), "task")
    else:
        found = found.withColumn("heavy", F.lit(False)).withColumn("task", plain_task)
    dealt = found.repartitionById(tasks, "task").drop("task").sortWithinPartitions("key", "ctx", "row", "pos")

    def shared(batches):
        """Rows of keys with two places or more; chosen: the first of each surrounding, many: there are others like it.

        Rows of a heavy key always stay: there are others in other tasks.  A surrounding that is dealt over tasks has a
        first place in each, and the shard finds them alike."""
        held, nth, alone = None, 0, True  # the last row waits for the next; its number in its surrounding; no row of its key before it
        for batch in chain(batches, [None]):
            table = pa.Table.from_batches([x for x in (held, batch) if x is not None]) if held or batch else None
            if table is None or not len(table):
                continue
            key, ctx = table["key"].to_numpy(), table["ctx"].to_numpy()
            same_key = np.concatenate([key[1:] == key[:-1], [False]])
            same = same_key & np.concatenate([ctx[1:] == ctx[:-1], [False]])
            starts = np.concatenate([[0], np.flatnonzero(~same[:-1]) + 1])
            number = np.arange(len(key)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(key)]])))
            number[: starts[1] if len(starts) > 1 else len(key)] += nth
            shares = same_key | np.concatenate([[not alone], same_key[:-1]]) | table["heavy"].to_numpy()
            n = len(key) - (batch is not None)
            out = table.slice(0, n).drop_columns("heavy").append_column("chosen", pa.array(number[:n] == 0)).append_column("many", pa.array(same[:n]))
            yield from out.filter(pa.array(shares[:n])).to_batches()
            held = table.slice(n).combine_chunks().to_batches()[0] if batch is not None else None
            nth, alone = int(number[-1]), not (same_key[-2] if len(key) > 1 else not alone)

    places = written(dealt.mapInArrow(shared, "key bigint, ctx bigint, row bigint, pos int, span int, chosen boolean, many boolean"))
    chosen = places.filter("chosen").select("key", "ctx", "row", "pos", "span", "many")
    # written, so that the joins with it have two sides already dealt out, of which Spark can split a hot key
    sizes = written(chosen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    before, after = F.shiftright("span", 16), F.col("span").bitwiseAND(0xFFFF)
    single = chosen.filter(F.col("many") & (before + after >= length)).join(sizes, "key", "left_anti")
    whole = single.select("ctx", (-before).alias("low"), after.alias("high"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    several = chosen.join(sizes, "key").select("row", F.struct("key", "ctx", "pos", "many", F.col("n").cast("int").alias("n"), "span").alias("wanted"))
    wanted = several.groupBy("row").agg(F.collect_list("wanted").alias("wanted"))

    def cut(batches):
        for batch in batches:
            for data, row, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = zlib.decompress(data)
                fields = asked.values
                key, ctx, pos = (fields.field(i).to_numpy() for i in range(3))
                pos = pos.astype(np.int64)
                span = fields.field(5).to_numpy()
                begin, end = pos - (span >> 16), pos + (span & 0xFFFF)
                parts = [data[a:c] + data[c + core : b] for a, c, b in zip(begin.tolist(), pos.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ctx), pa.array(np.full(len(pos), row, np.int64)), pa.array(pos), pa.array((pos - begin).astype(np.int32)), fields.field(3), fields.field(4), pa.array(parts, pa.binary())],
                    names=["key", "ctx", "row", "pos", "before", "many", "n", "bytes"],
                )

    around_layout = "key bigint, ctx bigint, row bigint, pos bigint, before int, many boolean, n int, bytes binary"
    texts = packed_texts(source, kind)
    around = texts.select("data", "row").join(wanted, "row").select("data", "row", "wanted").mapInArrow(cut, around_layout)
    shards = max(1, -(-total * 2 * width // shard_bytes))
    # a group: the surroundings of many keys (a, b are -1), or two blocks, or one, of the surroundings of one key
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("ctx", "row", "pos"), blocks.cast("bigint")).cast("int")
    alone_in = F.array(F.struct(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("group"), F.lit(-1).alias("a"), F.lit(-1).alias("b")))
    paired = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.col("key").alias("group"), F.least("own", other).alias("a"), F.greatest("own", other).alias("b")))
    grouped = around.withColumn("own", own).withColumn("to", F.explode(F.when(blocks == 1, alone_in).otherwise(paired))).select("*", "to.group", "to.a", "to.b").drop("to", "n")

    def in_group(key, table):
        if key[1].as_py() == key[2].as_py():
            cores = table["key"].to_numpy().view(np.uint64)
            parts = max(1, pc.sum(pc.binary_length(table["bytes"])).as_py() // CACHED)
            part = cores % np.uint64(parts)
            out = []
            for nth in range(parts):
                shard, ctx = _shards([table.filter(pa.array(part == nth))], width)[0]
                out.append(_found(shard, shard.repeated(), ctx, length))
            return pa.concat_tables(out)
        mine = pc.equal(table["own"], key[1])
        (one, ctx_one), (two, ctx_two) = _shards([table.filter(mine), table.filter(pc.invert(mine))], width)
        mask_one, mask_two = merged(one, two)
        return pa.concat_tables([_found(one, mask_one, ctx_one, length), _found(two, mask_two, ctx_two, length)])

    marks = grouped.groupBy("group", "a", "b").applyInArrow(in_group, "ctx bigint, low int, high int")
    marks = written(marks.union(whole).distinct())
    spans = places.select("ctx", "row", "pos").distinct().join(marks, "ctx").select("row", (F.col("pos") + F.col("low")).alias("low"), (F.col("pos") + F.col("high")).alias("high"))
    lost = spans.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("lost"))
    joined = texts.join(lost, "row", "left").select("id", "data", "lost")

    def removed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                out = []
                for data, spans in zip(piece.column(1).to_pylist(), piece.column(2), strict=True):
                    data = zlib.decompress(data)
                    kept, n_spans = data, 0
                    if spans.is_valid:
                        step = np.zeros(len(data) + 1, np.int32)
                        np.add.at(step, spans.values.field(0).to_numpy(), 1)
                        np.add.at(step, spans.values.field(1).to_numpy(), -1)
                        mask = np.cumsum(step)[:-1] > 0
                        kept, n_spans = np.frombuffer(data, np.uint8)[~mask].tobytes(), len(runs(mask)[0])
                    out.append((len(data), len(data) - len(kept), n_spans, kept, hashlib.sha256(kept).hexdigest()))
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True))], names=names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    return joined.mapInArrow(removed, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
