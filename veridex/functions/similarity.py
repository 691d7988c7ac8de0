"""Edit similarity of names, which Spark has no expression for: Arrow batches through a bit-parallel subsequence length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; one step of whole-number arithmetic for each character of b."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for at, char in enumerate(a):
        places[char] = places.get(char, 0) | 1 << at
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & places.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b)); two empty texts are alike."""
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


def set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared tokens and each side's shared tokens followed by its own."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    shared = " ".join(sorted(one & two))
    left, right = (" ".join(filter(None, [shared, " ".join(sorted(x))])) for x in (one - two, two - one))
    if shared and (one <= two or two <= one):
        return 100.0
    pairs = [(left, right)] + ([(shared, left), (shared, right)] if shared else [])
    return max(ratio(x, y) for x, y in pairs)


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio() of two columns; null where either is."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """set_ratio() of two columns; null where either is."""
    return pd.Series([None if x is None or y is None else set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")
