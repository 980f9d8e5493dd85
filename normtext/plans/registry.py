"""Collects the registered queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under ``name``; ``sql`` may be None where no SQL can say it."""

        def register(query: Query) -> Query:
            assert name not in self.queries, name
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register
