"""Where queries are put down by name, each with the SQL that gives the same rows where there is one. ``catalogue`` has them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "span_segments"


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL over the same tables that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
