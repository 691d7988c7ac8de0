"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of word bytes within one text.  Its hash is a polynomial in its bytes modulo 2**64, read off one
prefix sum over the whole buffer and then mixed, so the cost is a few vector operations a byte and none a word.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(kind: str) -> np.ndarray:
    """Which bytes belong to words: 'alnum' has digits, a-z and all bytes above ASCII; 'solid' all but blanks."""
    byte = np.arange(256)
    if kind == "alnum":
        return (byte >= 0x80) | ((byte >= 0x30) & (byte <= 0x39)) | ((byte >= 0x61) & (byte <= 0x7A))
    return ~((byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes each output bit half the time."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n."""
    if len(_POWERS[0]) <= n:
        for slot, base in enumerate((BASE, _INVERSE)):
            row = np.full(n + 1, base, np.uint64)
            row[0] = 1
            _POWERS[slot] = np.cumprod(row)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def spans(raw: np.ndarray, ends: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the buffer, and for each text the number of its first word (one more at the end)."""
    inside = member[raw]
    first, last = inside.copy(), inside.copy()
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    if len(raw):
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[cuts] = False
        first &= ~before
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[cuts - 1] = False
        last &= ~after
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, ends)


def sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of the buffer's polynomial, from which the hash of any span is read."""
    up, _ = powers(len(raw))
    values = raw.astype(np.uint64)
    values += np.uint64(1)
    values *= up[: len(raw)]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total


def hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of the buffer that depends on its bytes alone; total: the buffer's sums, if at hand."""
    _, down = powers(len(raw))
    total = sums(raw) if total is None else total
    return mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row, at the place of the first; texts aren't told apart here."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + words[j : j + n]
    return mix(out)
