"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from veridex.plans import analysis, contracts, gates, reading, relational, routing, search, selection, summaries, trajectories

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (routing, relational, selection, search, analysis, contracts, trajectories, gates, reading, summaries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
