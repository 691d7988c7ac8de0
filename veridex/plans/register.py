"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable


def registrar() -> tuple[Callable, dict, dict]:
    """(decorator, queries, SQL): @query(name, sql) puts a function of (spark, sf_dir) and its SQL, if any, into the two."""
    queries, oracles = {}, {}

    def query(name: str, sql: str | None = None):
        def register(run):
            queries[name] = run
            if sql:
                oracles[name] = sql
            return run

        return register

    return query, queries, oracles
