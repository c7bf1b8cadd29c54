"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is the same question in SQL over the same tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from quorate.plans.catalog import costs, evaluation, jobs, parsing, repairs, requests, rollups, sinks_and_hooks, storage, streams, verifying, votes  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
