"""Byte-level BPE encoding and decoding: a segment tree over the byte positions of each pre-token.

The leaf of a live position holds the rank of the pair that starts there, times the width, plus the position; so the root
holds the least rank and, among equal ranks, the leftmost place.  A merge changes three leaves (the merged position, its
live neighbour on the left, the position that ends) and the nodes above them.  Short pre-tokens of one width are worked on
together: a round merges the root's pair of each of them, as array operations; longer ones have a tree of their own, so
a stretch of n bytes that the pattern leaves unsplit takes n log n steps.

Ranks are ids: a pair's rank is that of its bytes in the vocabulary, and a pre-token that is in the vocabulary as a whole
is that token, as the tiktoken library has it.  The classes of the splitting pattern are that library's too: code points
that another version of Unicode puts into another class are found when the vocabulary is loaded, and texts that hold one
are split by classes spelt out.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veridex.llm.arrowtext import map_texts

NONE = np.int32(2**31 - 1)
_LOADED: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Splitter:
    """Splits texts by a pattern over \\s, \\p{L} and \\p{N}, with the classes that tiktoken has for them."""

    def __init__(self, pattern: str):
        import tiktoken

        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        single = {bytes([b]): b for b in range(256)}
        differ, held = set(), {}
        for name in (r"\p{L}", r"\p{N}"):
            probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
            found = bytes(probe.encode_ordinary(every)).decode()  # what the class doesn't hold leaves no bytes
            differ |= set(found) ^ set(regex.findall(name, every))
            held[name] = _ranges(found)
        explicit = ""
        for part in re.split(r"(\[[^\]]*\])", pattern):  # classes in brackets, and what stands between them
            for name, ranges in held.items():
                part = part.replace(name, ranges if part.startswith("[") else f"[{ranges}]")
            explicit += part
        self.usual = regex.compile(pattern).findall
        self.explicit = regex.compile(explicit).findall
        self.other = re.compile(f"[{_ranges(''.join(sorted(differ)))}]").search if differ else lambda text: None

    def __call__(self, text: str) -> list[str]:
        return (self.explicit if self.other(text) else self.usual)(text)


def _ranges(characters: str) -> str:
    """The inside of a character class for characters in rising order."""
    codes = np.array(list(map(ord, characters)))
    cut = np.flatnonzero(np.diff(codes) != 1)
    first, last = codes[np.r_[0, cut + 1]], codes[np.r_[cut, len(codes) - 1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


class SegmentTreeEncoder:
    """Encodes and decodes with the ranks of a file; entries bounds how many pre-tokens a task remembers."""

    def __init__(self, path: str, pattern: str, wide: int = 64, entries: int = 400_000):
        self.ranks = read_ranks(path)
        self.split = Splitter(pattern)
        self.wide, self.entries = wide, entries
        by_rank = sorted(self.ranks, key=self.ranks.__getitem__)
        rank = np.array([self.ranks[t] for t in by_rank])
        size = np.zeros(rank[-1] + 1, np.int64)
        size[rank] = list(map(len, by_rank))
        self.size, self.begin = size, np.cumsum(size) - size
        self.blob = np.frombuffer(b"".join(by_rank), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

        self.pairs = {}
        for token, merged in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = merged
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.first, self.count, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """What the leaves of pairs of tokens hold; -1 stands for no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at] * width + place, NONE).astype(np.int32)

    def merge_short(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many each has) of pieces of at most width bytes, a power of two."""
        n, depth = len(pieces), width.bit_length() - 1
        length = np.array(list(map(len, pieces)))
        raw = np.frombuffer(b"".join(piece.ljust(width, b"\0") for piece in pieces), np.uint8).reshape(n, width)
        place = np.arange(width)
        token = np.full((n, width + 1), -1, np.int64)  # the last column stands for both ends
        token[:, :width] = np.where(place < length[:, None], self.of_byte[raw], -1)
        after = np.broadcast_to(np.r_[place + 1, width], token.shape).copy()
        before = np.broadcast_to(np.r_[width, place], token.shape).copy()
        tree = np.full((n, 2 * width), NONE, np.int32)
        tree[:, width:] = self.leaves(token[:, :-1], token[:, 1:], place, width)
        at = width
        while at > 1:
            tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
            at //= 2

        token1, after1, before1, tree1 = token.reshape(-1), after.reshape(-1), before.reshape(-1), tree.reshape(-1)
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            base, top = row * (width + 1), row * (2 * width)
            root = tree1[top + 1].astype(np.int64)
            here, new = root & (width - 1), root >> depth
            gone = after1[base + here]
            following, earlier = after1[base + gone], before1[base + here]
            token1[base + here], token1[base + gone] = new, -1
            after1[base + here], before1[base + following] = following, here
            tree1[top + width + gone] = NONE
            tree1[top + width + here] = self.leaves(new, token1[base + following], here, width)
            inner = np.flatnonzero(earlier < width)
            left = earlier[inner]
            tree1[top[inner] + width + left] = self.leaves(token1[base[inner] + left], new[inner], left, width)
            nodes = np.stack([gone, here, np.where(earlier < width, earlier, here)]) + width
            for _ in range(depth):
                nodes >>= 1
                tree1[top + nodes] = np.minimum(tree1[top + 2 * nodes], tree1[top + 2 * nodes + 1])
            row = row[tree1[top + 1] != NONE]
        live = token[:, :-1] >= 0
        return token[:, :-1][live].astype(np.int32), live.sum(1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        depth, pairs, none = width.bit_length() - 1, self.pairs, 1 << 62
        start = self.of_byte[np.frombuffer(piece, np.uint8)]
        level = np.full(width, none, np.int64)
        found = self.leaves(start[:-1], start[1:], np.int64(0), 1).astype(np.int64)
        level[: n - 1] = np.where(found == NONE, none, (found << depth) + np.arange(n - 1))
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree = array("q", np.concatenate([[none], *levels[::-1]]).astype(np.int64).tobytes())
        token = array("q", start.astype(np.int64).tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

        def put(place: int, value: int) -> None:
            node = place + width
            tree[node] = value
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    return  # nothing above changes
                tree[node] = least

        while (root := tree[1]) != none:
            here, new = root & (width - 1), root >> depth
            gone = after[here]
            following, earlier = after[gone], before[here]
            token[here], token[gone], after[here] = new, -1, following
            put(gone, none)
            pair = none
            if following < n:
                before[following] = here
                merged = pairs.get(new << 32 | token[following])
                pair = none if merged is None else merged << depth | here
            put(here, pair)
            if earlier >= 0:
                merged = pairs.get(token[earlier] << 32 | new)
                put(earlier, none if merged is None else merged << depth | earlier)
        out = np.frombuffer(token, np.int64)
        return out[out >= 0].astype(np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces that the task hasn't met and remembers their ids."""
        by_width: dict[int, list[str]] = {}
        raw = {piece: piece.encode() for piece in pieces}
        names, found, counts = [], [], []
        for piece, data in raw.items():
            whole = self.ranks.get(data)
            if whole is not None:
                names.append(piece)
                found.append(np.array([whole], np.int32))
                counts.append(np.array([1]))
            elif len(data) > self.wide:
                names.append(piece)
                found.append(self.merge_long(data))
                counts.append(np.array([len(found[-1])]))
            else:
                by_width.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append(piece)
        for width, own in by_width.items():
            step = max(1, (1 << 19) // width)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                ids, count = self.merge_short([raw[piece] for piece in part], width)
                names += part
                found.append(ids)
                counts.append(count)
        known = len(self.index)
        self.index.update(zip(names, range(known, known + len(names)), strict=True))
        count = np.concatenate([self.count, *counts])
        self.flat = np.concatenate([self.flat, *found])
        self.count, self.first = count, np.cumsum(count) - count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has)."""
        pieces, ends = [], [0]
        for text in texts:
            pieces += self.split(text)
            ends.append(len(pieces))
        if len(self.index) > self.entries or len(self.flat) > 8 * self.entries:
            self.forget()
        unknown = set(pieces).difference(self.index)
        if unknown:
            self.learn(list(unknown))
        number = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        count = self.count[number]
        total = np.r_[0, np.cumsum(count)]
        return self.flat[ragged(self.first[number], count)], np.diff(total[np.array(ends)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts one after the other, how many each has)."""
        size = self.size[ids]
        total = np.r_[0, np.cumsum(size)]
        return self.blob[ragged(self.begin[ids], size)], np.diff(total[np.r_[0, np.cumsum(counts)]])


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of count numbers each, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def encoder(path: str, pattern: str, wide: int, entries: int) -> SegmentTreeEncoder:
    """One loaded vocabulary a worker process."""
    key = (path, pattern, wide, entries)
    if key not in _LOADED:
        _LOADED[key] = SegmentTreeEncoder(*key)
    return _LOADED[key]


def encode_decode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", wide: int = 64, entries: int = 400_000
) -> DataFrame:
    """One row for each row of docs: id_col, ids array<int>, decoded binary.

    No row moves between tasks.  Pre-tokens of over wide bytes have a tree of their own; a task forgets the pre-tokens it
    has met when they are more than entries.  A null text counts as empty: no ids, no bytes.  Repeated rows and null ids
    give a row each; an empty table gives none.  Other columns of docs are not read, so their names can't clash.
    """

    def make():
        model = encoder(path, pattern, wide, entries)

        def work(texts):
            ids, counts = model.encode(["" if text is None else text for text in texts.to_pylist()])
            data, sizes = model.decode(ids, counts)
            ends = np.cumsum(np.r_[0, sizes]).astype(np.int32)
            back = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
            return [pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, counts]).astype(np.int32)), pa.array(ids)), back]

        return work

    return map_texts(docs, id_col, text_col, "ids array<int>, decoded binary", make)
