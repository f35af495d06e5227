"""Named queries: a builder over (spark, sf_dir), and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

BUILDERS: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(builder: Builder) -> Builder:
        if name in BUILDERS:
            raise ValueError(f"two queries are called {name}")
        BUILDERS[name] = builder
        if sql:
            SQL[name] = sql
        return builder

    return add
