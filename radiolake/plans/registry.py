"""Registries of queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[[str | None], Callable[[Query], Query]]]:
    """(queries by name, SQL by name, decorator that enters a query with its SQL)."""
    queries: dict[str, Query] = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return register

    return queries, sqls, query
