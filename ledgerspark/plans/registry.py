"""Registry of named queries: each has a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
when the query is expressible in plain SQL, the DuckDB oracle text over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from ledgerspark.plans import (  # noqa: F401
        event_queries, ledger_queries, pattern_queries, report_queries, source_queries, stream_queries,
        summary_queries,
    )
