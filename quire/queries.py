"""The named queries of the library with their oracle SQL; modules add theirs to the two dictionaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a (spark, sf_dir) function under ``name``, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quire import catalog  # noqa: F401  registers on import

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from quire import catalog  # noqa: F401

    return dict(ORACLES)
