"""Queries over the fixture views, each with the statement that the oracle engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skerry.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *views: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of the named views (as DataFrames) under its own name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[fixtures.view(spark, sf_dir, v) for v in views])
        if oracle:
            ORACLES[f.__name__] = fixtures.oracle(oracle)
        return f

    return add


def statement(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a report that is one SQL statement; both engines run it."""
    QUERIES[name] = lambda spark, sf_dir: fixtures.run(spark, sf_dir, sql)
    ORACLES[name] = fixtures.oracle(oracle or sql)
