"""Language-model scores by a weighted backoff automaton.

The model holds every word, pair and triple of the training texts, whatever the size of the corpus.  Texts are dealt into
blocks by a hash of their rows.  Each block lists its distinct words, pairs and triples with their training counts, sorted
by name and cut at fixed borders, and sends each cut to the bucket of its range; a bucket sums the counts of all blocks and
answers each of them in the order of its list, so that answers need no names.  No task, broadcast or driver ever holds the
vocabulary or the model: a block gets the states and arcs that its own texts can reach.

The automaton: a state is a history of up to two words that training texts hold.  An arc leads from a state over a word to
the longest such history that then ends the text, if training texts hold history and word together; its weight is the
smoothed log-probability p(w | h) = (c(hw) + strength p(w | h')) / (c(h) + strength), with h' the history without its
first word, and p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) at the empty one (the hierarchical Dirichlet smoothing of MacKay
and Peto).  Where a state has no arc for a word, its failure arc, of weight strength / (c(h) + strength), leads to h'.
Each text is read once from left to right; the state is carried and log-weights are summed.

Words are named by 64 bits, pairs and triples by 56: among 10**10 of those one in seven million shares its name, and then
its count, with another.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veridex.llm import wordhash
from veridex.llm.arrowtext import lower_ascii, pieces, utf8

#: The token after the last word of each text; a word has this hash only by chance.
END = 0x5851F42D4C957F2D
#: Tokens of a block of texts, and entries of a bucket of counts; both bound what a task holds.
BLOCK_TOKENS = 2_500_000
BUCKET_ENTRIES = 4_000_000
#: Distinct words that a task collects before it passes them on.
WORDS_HELD = 3_000_000


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of all texts in a row, offsets of the texts): words, then the end."""
    raw, ends = utf8(texts)
    raw = lower_ascii(raw)
    starts, stops, first = wordhash.spans(raw, ends, wordhash.table("solid"))
    words = wordhash.hashes(raw, starts, stops)
    offsets = first + np.arange(len(first))
    out = np.full(offsets[-1], END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = words
    return out, offsets


def grouped(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(names, return_inverse=True) for hashes of so many bits, in a third of the time.

    What is sorted are single numbers: the leading bits of a hash with its place below them.  Hashes that only differ
    further down, which is rare, are put in order afterwards.
    """
    width = max(1, len(names) - 1).bit_length()
    mask = np.uint64((1 << width) - 1)
    packed = np.sort(names << np.uint64(64 - bits) & ~mask | np.arange(len(names), dtype=np.uint64))
    order, lead = (packed & mask).astype(np.int64), packed >> np.uint64(width)
    value = names[order]
    for at in np.unique(lead[np.flatnonzero(value[1:] < value[:-1])]).tolist():
        some = slice(*np.searchsorted(lead, np.array([at, at + 1], np.uint64)).tolist())
        order[some] = order[some][np.argsort(value[some], kind="stable")]
        value[some] = names[order[some]]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    back = np.empty(len(names), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return value[new], back


class Grams:
    """The tokens of a block's texts and the names of their words, pairs and triples.

    names: sorted names of words, and of pairs and triples together; place: for each token where in them the word, pair
    and triple stands that ends at it, -1 where the text has none.
    """

    def __init__(self, texts: pa.Table, column: str):
        found = [tokens(piece.column(0)) for piece in pieces(texts.select([column]).to_batches(), 0)]
        word = np.concatenate([hashed for hashed, _ in found]) if found else np.empty(0, np.uint64)
        self.sizes = np.concatenate([np.diff(offsets) for _, offsets in found]) if found else np.empty(0, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        two = np.ones(len(word), bool)
        two[self.offsets[:-1]] = False
        three = two.copy()
        three[1:] &= two[:-1]
        at2, at3 = np.flatnonzero(two), np.flatnonzero(three)
        pair = wordhash.grams(word, 2)[at2 - 1] >> np.uint64(8)
        triple = wordhash.grams(word, 3)[at3 - 2] >> np.uint64(8)
        words, in_words = grouped(word, 64)
        others, in_others = grouped(np.concatenate([pair, triple]), 56)
        self.names = (words, others)
        self.place = [in_words, np.full(len(word), -1, np.int32), np.full(len(word), -1, np.int32)]
        self.place[1][at2] = in_others[: len(at2)]
        self.place[2][at3] = in_others[len(at2) :]

    def counts(self, per_token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the tokens at which each name ends."""
        one = np.bincount(self.place[0], weights=per_token, minlength=len(self.names[0]))
        held = [place >= 0 for place in self.place[1:]]
        ends = np.concatenate([place[ok] for place, ok in zip(self.place[1:], held, strict=True)])
        other = np.bincount(ends, weights=np.concatenate([per_token[ok] for ok in held]), minlength=len(self.names[1]))
        return one.astype(np.int64), other.astype(np.int64)


def planes(values: np.ndarray, random: int) -> bytes:
    """Numbers by bytes of equal weight; the lowest ``random`` of them as they are, the others, mostly zero, compressed."""
    table = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return table[:random].tobytes() + zlib.compress(table[random:].tobytes(), 1)


def from_planes(data: bytes, n: int, random: int) -> np.ndarray:
    whole = data[: random * n] + zlib.decompress(data[random * n :])
    return np.ascontiguousarray(np.frombuffer(whole, np.uint8).reshape(8, n).T).view("<u8").ravel()


def bucket_of(names: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Equal ranges of names."""
    return ((names >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: For words, and for pairs and triples: bits of a name, and bytes of a step between neighbours that are random.
KINDS = ((64, 5), (56, 4))
CELL = "bucket int, block int, kind int, n int, names binary, counts binary"


def cells(grams: Grams, train: np.ndarray, block: int, buckets: int) -> pa.Table:
    """The block's lists cut by bucket: steps between sorted names, and counts in training texts."""
    rows = []
    for kind, (names, counts, (bits, random)) in enumerate(zip(grams.names, grams.counts(train), KINDS, strict=True)):
        bucket = bucket_of(names, bits, buckets)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(names) else np.empty(0, np.int64)
        for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(names)], strict=False):
            steps = np.diff(names[begin:end], prepend=np.uint64(0))
            rows.append((int(bucket[begin]), block, kind, end - begin, planes(steps, random), planes(counts[begin:end], 0)))
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "block", "kind", "n", "names", "counts"])


def summed(table: pa.Table) -> pa.Table:
    """A bucket's cells with the counts of all blocks, in the order of each cell."""
    kinds, sizes, answers = table["kind"].to_numpy(), table["n"].to_numpy(), [b""] * len(table)
    for kind, (bits, random) in enumerate(KINDS):
        mine = np.flatnonzero(kinds == kind)
        if not len(mine):
            continue
        own = table.take(pa.array(mine))
        steps = zip(own["names"].to_pylist(), sizes[mine].tolist(), strict=True)
        names = np.concatenate([np.cumsum(from_planes(data, n, random)) for data, n in steps])
        counts = zip(own["counts"].to_pylist(), sizes[mine].tolist(), strict=True)
        counts = np.concatenate([from_planes(data, n, 0) for data, n in counts])
        back = grouped(names, bits)[1]
        total = np.bincount(back, weights=counts).astype(np.int64)[back]
        ends = np.cumsum(sizes[mine])
        for row, begin, end in zip(mine.tolist(), (ends - sizes[mine]).tolist(), ends.tolist(), strict=True):
            answers[row] = planes(total[begin:end], 0)
    return table.select(["block", "kind", "bucket", "n"]).append_column("counts", pa.array(answers, pa.binary()))


def answered(table: pa.Table, kind: int) -> np.ndarray:
    """The counts that a block got for its list of names, in the list's order."""
    own = table.filter(pc.equal(table["kind"], kind)).sort_by("bucket")
    parts = [from_planes(data, n, 0) for data, n in zip(own["counts"].to_pylist(), own["n"].to_pylist(), strict=True)]
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


class Automaton:
    """The states and arcs that a block's tokens can reach, and the traversal of its texts."""

    def __init__(self, grams: Grams, words: np.ndarray, others: np.ndarray, total: int, kinds: int, strength: float):
        self.grams, self.strength = grams, strength
        self.words, self.others = words, np.concatenate([others, [0]])  # place -1: nothing there
        self.single = np.log10((words + 0.5) / (total + 0.5 * (kinds + 1)))

    def columns(self, begin: int, end: int) -> list[list]:
        """For each token from begin to end: is there an arc from a word, from a pair, is the word known; the weights of the
        arcs of the empty history, a word and a pair; the weights of the failure arcs of a word and a pair."""
        low = max(0, begin - 1)
        one, two, three = (place[low:end] for place in self.grams.place)
        c1, c2, c3 = self.words[one], self.others[two], self.others[three]
        h1, h2 = (np.concatenate([[0], c[:-1]]) + self.strength for c in (c1, c2))
        arc1 = self.single[one]
        p2 = (c2 + self.strength * 10.0**arc1) / h1
        p3 = (c3 + self.strength * p2) / h2
        fail = np.log10(self.strength) - np.log10([h1, h2])
        found = [c2 > 0, c3 > 0, c1 > 0, arc1, np.log10(p2), np.log10(p3), *fail]
        return [column[begin - low :].tolist() for column in found]

    def read(self, step: int = 1 << 16) -> list[float]:
        """The log-probability of each text, read from left to right from the empty history."""
        out, total, state = [], 0.0, 0  # state: words of the history
        starts = np.zeros(len(self.grams.place[0]), bool)
        starts[self.grams.offsets[:-1]] = True
        for begin in range(0, len(starts), step):
            end = min(begin + step, len(starts))
            columns = self.columns(begin, end)
            for start, held2, held3, known, arc1, arc2, arc3, fail1, fail2 in zip(starts[begin:end].tolist(), *columns, strict=True):
                if start:
                    out.append(total)
                    total, state = 0.0, 0
                if state == 2:
                    if held3:
                        total += arc3
                        continue
                    total += fail2
                if state:
                    if held2:
                        total += arc2
                        state = 2
                        continue
                    total += fail1
                total += arc1
                state = 1 if known else 0
        return [*out[1:], total]


def _train(id_col: Column) -> Column:
    """Whether a document is learned from: crc32 of its id as text, modulo 5, is not 1; a null id is an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 != 1


def _tallied(batches):
    """(h, train, all): each distinct training word of the task, and one row of the task's token counts."""
    held, size, train, every = [], 0, 0, 0

    def rows(h: np.ndarray):
        for at in range(0, len(h), 1 << 20):
            some = h[at : at + (1 << 20)].view(np.int64)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(some), none, none], names=["h", "train", "all"])

    for piece in pieces(batches, 0):
        hashed, offsets = tokens(piece.column(0))
        own = np.repeat(piece.column(1).to_numpy(zero_copy_only=False), np.diff(offsets))
        train, every = train + int(own.sum()), every + len(own)
        held.append(np.unique(hashed[own]))
        size += len(held[-1])
        if size > WORDS_HELD:
            held = [np.unique(np.concatenate(held))]
            size = len(held[0])
            if size > WORDS_HELD // 2:
                yield from rows(held[0])
                held, size = [], 0
    if held:
        yield from rows(np.unique(np.concatenate(held)))
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([train]), pa.array([every])], names=["h", "train", "all"])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strength: float = 2.0) -> DataFrame:
    """One row for each row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs of characters other than blanks, with A-Z lower-cased, and one end a text.  Training texts are those
    whose crc32(id as text) modulo 5 is not 1.  base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens; score
    sums the automaton's weights.  strength: how many tokens of a history its shorter history is worth.

    A null or empty text is the end alone.  Repeated rows count and are scored each, in one block; a null id is a training
    document.  An empty table gives no rows.  Other columns of docs are not read.  A very long text is a block of its own
    size at least.  docs is read twice, for the totals and for the blocks, and should give the same rows both times.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("train", _train(F.col("id")))

    found = source.select("text", "train").mapInArrow(_tallied, "h bigint, train bigint, all bigint")
    by_word = found.groupBy("h").agg(F.sum("train").alias("train"), F.sum("all").alias("all"))
    kinds, total, every = by_word.agg(F.count("h"), F.coalesce(F.sum("train"), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0))).first()
    blocks, buckets = max(1, -(-every // BLOCK_TOKENS)), max(1, -(-2 * every // BUCKET_ENTRIES))

    # each number is a partition; both uses of the dealt texts share one shuffle
    dealt = source.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")

    def listed(key, table):
        grams = Grams(table, "text")
        return cells(grams, np.repeat(table["train"].to_numpy(), grams.sizes), key[0].as_py(), buckets)

    asked = dealt.groupBy("block").applyInArrow(listed, CELL).repartitionById(buckets, "bucket")
    answers = asked.groupBy("bucket").applyInArrow(summed, "block int, kind int, bucket int, n int, counts binary")

    def scored(texts, answers):
        if not len(texts):
            return pa.table([pa.array([], t) for t in types], names=names)
        grams = Grams(texts, "text")
        automaton = Automaton(grams, answered(answers, 0), answered(answers, 1), total, kinds, strength)
        score = automaton.read()
        base = np.add.reduceat(automaton.single[grams.place[0]], grams.offsets[:-1])
        n_known = np.add.reduceat((automaton.words > 0)[grams.place[0]], grams.offsets[:-1], dtype=np.int64)
        columns = [texts["id"], pc.invert(texts["train"]), grams.sizes, n_known, np.full(len(score), total, np.int64), base, score]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [to_arrow_type(docs.schema[id_col].dataType), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    back = answers.repartitionById(blocks, "block")
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(scored, schema)
