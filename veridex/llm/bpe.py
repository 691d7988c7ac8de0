"""BPE encoding and decoding of whole texts by tree concatenation.

A text of more than ``span`` characters is a tree: it is halved down to parts of that length, which threads encode in
parallel; at each join a window of text is encoded again and widened until it begins and ends at cuts that both sides
have as ends of tokens.  Text that the vocabulary's splitting pattern leaves unsplit over more than ``leaf`` characters
(long words, numbers, signs, blank runs) is a tree of its own inside a part: its halves' halves go to the threads too, and
at each join a window of tokens is encoded again and grown until it agrees with the left side in its first token and with
the right side in its last.  A sequence of tokens is the encoding of its text if each adjacent pair is, so one agreed
token on either side makes the joined sequence the encoding of the whole.  All else goes through the pattern as it stands.

Windows of text end, and long runs are taken out of it, at cuts before a single space that stands between two characters
that aren't white space: the pattern has a boundary there whatever surrounds it, and no special token holds a space.
"""

from __future__ import annotations

import json
import os
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veridex.llm.arrowtext import map_texts

SAFE = re.compile(r"(?<=\S)(?= \S)")
#: The splitting pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TreeEncoder:
    """Encodes and decodes with the vocabulary of a tokenizers file."""

    def __init__(self, path: str, leaf: int = 1024, window: int = 8, span: int = 16_384, threads: int = 2):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {token.content: number for number, token in self.tokenizer.get_added_tokens_decoder().items()}
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte = byte_characters()
        ranks = {bytes(map(byte.__getitem__, token)): rank for token, rank in vocabulary.items() if token not in self.special}
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.leaf, self.window, self.span = leaf, window, span
        self.pool = ThreadPoolExecutor(threads)  # the encoder works outside the interpreter's lock
        self.long = re.compile(rf"\S{{{leaf + 1},}}|\s{{{leaf + 1},}}")
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str) -> np.ndarray:
        """The library's ids of one text, special strings in it as the library has them."""
        parts = self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]
        found = []
        for part in parts:
            if part in self.special:
                found.append(np.array([self.special[part]], np.int32))
            elif part:
                found += self.halved(part)
        return np.concatenate(found) if len(found) > 1 else found[0] if found else np.empty(0, np.int32)

    def halved(self, text: str) -> list[np.ndarray]:
        """Ids of text without special strings: its parts' ids, with windows in their place around the joins."""
        ends = self.part_ends(text) if len(text) > self.span else [0, len(text)]
        if len(ends) == 2:
            return self.stretch(text)
        # a part whose unsplit text needs the threads itself would wait for them: such parts go one by one
        parts = [text[begin:end] for begin, end in zip(ends, ends[1:], strict=False)]
        run = map if self.long.search(text) else self.pool.map
        found = run(lambda part: np.concatenate(self.stretch(part)), parts)
        sides = list(zip(ends, ends[1:], found, strict=False))
        while len(sides) > 1:
            odd = [sides.pop()] if len(sides) % 2 else []
            sides = [self.spliced(text, *pair) for pair in zip(sides[::2], sides[1::2], strict=True)] + odd
        return [sides[0][2]]

    def part_ends(self, text: str) -> list[int]:
        """Where repeated halving ends the parts of a text; parts without a cut that a window could end at stay together."""
        parts = 1 << (-(-len(text) // self.span) - 1).bit_length()
        ends = [len(text) * i // parts for i in range(parts + 1)]
        has_cut = [bool(SAFE.search(text[begin:end])) for begin, end in zip(ends, ends[1:], strict=False)]
        kept, seen = [0], has_cut[0]
        for end, following in zip(ends[1:-1], has_cut[1:], strict=True):
            if seen and following:
                kept.append(end)
                seen = False
            seen = seen or following
        return [*kept, len(text)]

    def spliced(self, text: str, left: tuple, right: tuple) -> tuple:
        """(begin, end, ids) of two adjacent parts: a window around their join is encoded again, and widened until it
        begins and ends at cuts where both parts have the ends of tokens."""
        (begin, middle, one), (_, end, two) = left, right
        width = 8 * self.window
        while True:
            low, high = max(begin, middle - width), min(end, middle + width)
            before = [match.start() + low for match in SAFE.finditer(text[low:middle])][-1:]
            after = SAFE.search(text[middle:high])
            if before and after:
                a, b = before[0], middle + after.start()
                drop = self.tokens(one[::-1], len(text[a:middle].encode()))
                skip = self.tokens(two, len(text[middle:b].encode()))
                if drop is not None and skip is not None:
                    return begin, end, np.concatenate([one[: len(one) - drop], *self.stretch(text[a:b]), two[skip:]])
            if low == begin and high == end:
                return begin, end, np.concatenate(self.stretch(text[begin:end]))
            width *= 2

    def tokens(self, ids: np.ndarray, length: int) -> int | None:
        """How many of the first ids hold length bytes exactly."""
        held = np.cumsum([0, *map(self.sizes.__getitem__, ids[:length].tolist())])
        at = int(np.searchsorted(held, length))
        return at if at < len(held) and held[at] == length else None

    def ordinary(self, text: str) -> np.ndarray:
        return self.plain.encode_to_numpy(text, disallowed_special=()).view(np.int32)

    def stretch(self, text: str) -> list[np.ndarray]:
        """Ids of text without special strings: ordinary stretches between long units."""
        if not self.long.search(text):
            return [self.ordinary(text)]
        out, held = [], []
        for unit in SAFE.split(text):
            if not self.long.search(unit):
                held.append(unit)
                continue
            if held:
                out.append(self.ordinary("".join(held)))
                held = []
            for _, (begin, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit):
                out.append(self.tree(unit[begin:end]))
        return [*out, self.ordinary("".join(held))] if held else out

    def merged(self, piece: bytes) -> np.ndarray:
        """Ids of bytes that aren't split."""
        return np.array(self.plain._encode_single_piece(piece), np.int32)

    def tree(self, piece: str) -> np.ndarray:
        """Ids of one pre-token: those of its halves' halves, of at most leaf characters, joined two by two."""
        if len(piece) <= self.leaf:
            return self.merged(piece.encode())
        parts = 1 << (-(-len(piece) // self.leaf) - 1).bit_length()
        ends = [len(piece) * i // parts for i in range(parts + 1)]
        leaves = [piece[begin:end] for begin, end in zip(ends, ends[1:], strict=False)]  # the pattern leaves these unsplit too
        sides = list(self.pool.map(self.ordinary, leaves) if parts >= 64 else map(self.ordinary, leaves))
        data = [leaf.encode() for leaf in leaves]
        while len(sides) > 1:
            pairs = range(0, len(sides), 2)
            sides = [self.joined(sides[i], sides[i + 1], data[i], data[i + 1]) for i in pairs]
            data = [data[i] + data[i + 1] for i in pairs]
        return sides[0]

    def joined(self, left: np.ndarray, right: np.ndarray, one: bytes, two: bytes) -> np.ndarray:
        """Both sides' ids with a window around the join encoded again, grown until both sides agree."""
        width = self.window
        while True:
            a, b = left[-width:], right[:width]
            before, after = (sum(map(self.sizes.__getitem__, ids.tolist())) for ids in (a, b))
            again = self.merged(one[len(one) - before :] + two[:after])
            all_left, all_right = len(a) == len(left), len(b) == len(right)
            if (all_left or again[0] == a[0]) and (all_right or again[-1] == b[-1]) and (len(again) > 1 or all_left or all_right):
                return np.concatenate([left[: len(left) - len(a)], again, right[len(b) :]])
            width *= 2

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens as their strings."""
        return self.plain.decode_bytes(ids.tolist()).decode("utf-8", "replace")


def encoder(path: str, leaf: int, window: int, span: int, threads: int) -> TreeEncoder:
    """One loaded vocabulary a worker process."""
    key = (path, leaf, window, span, threads)
    if key not in _LOADED:
        _LOADED[key] = TreeEncoder(*key)
    return _LOADED[key]


def encode_decode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    leaf: int = 1024,
    window: int = 8,
    span: int = 16_384,
    threads: int = 2,
) -> DataFrame:
    """One row for each row of docs: id_col, ids array<int>, decoded string.

    No row moves between tasks; texts of over span characters are encoded in parts by threads.  A null text counts as
    empty: no ids, decoded to ''.  Repeated rows and null ids give a row each; an empty table gives none.  Other columns of docs are not read, so their names can't clash.
    """

    def make():
        model = encoder(path, leaf, window, span, threads)

        def work(texts):
            ids = [model.encode(text) if text else np.empty(0, np.int32) for text in texts.to_pylist()]
            back = [model.decode(own) for own in ids]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = pa.array(np.concatenate(ids))
            return [pa.ListArray.from_arrays(pa.array(ends), values), pa.array(back, pa.string())]

        return work

    return map_texts(docs, id_col, text_col, "ids array<int>, decoded string", make)
