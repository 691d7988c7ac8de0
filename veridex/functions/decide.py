"""Ordered decisions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(cases: list[tuple[Column, str]], default: str | None) -> Column:
    """The label of the first true condition; a NULL condition counts as false."""
    out = None
    for condition, label in cases:
        held = F.coalesce(condition, F.lit(False))
        out = F.when(held, F.lit(label)) if out is None else out.when(held, F.lit(label))
    return out.otherwise(F.lit(default))


def policy_a(mixed: Column, invalid: Column, present: Column) -> Column:
    """Policy A: conflicting endpoints come before invalid values, then evidence grounds."""
    return first_match([(mixed, "flag"), (invalid, "reject"), (present, "ground")], "defer")


def policy_b(mixed: Column, invalid: Column, present: Column) -> Column:
    """Policy B: invalid values come before conflicting endpoints."""
    return first_match([(invalid, "reject"), (mixed, "flag"), (present, "ground")], "defer")
