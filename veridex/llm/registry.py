"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from veridex.llm import queries_native, queries_scans, queries_shared, queries_turns

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (queries_native, queries_scans, queries_shared, queries_turns):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
