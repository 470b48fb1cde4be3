"""Registry of named queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def registered(sql: str | None):
    """Register a query by its function's name, beside the SQL for the same rows (None: rows only)."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add
