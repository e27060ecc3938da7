"""The registry of named queries: each a callable and, where SQL can express it, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Query]:
    """Registers ``f(t)`` under its own name, where ``t(name)`` reads a table, ``t.path(name)`` is its path and ``t.spark`` the session."""

    def wrap(f: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, directory: str) -> DataFrame:
            def read(name: str) -> DataFrame:
                return table(spark, directory, name)

            read.spark = spark
            read.path = lambda name: f"{directory}/{name}.parquet"
            return f(read)

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return run

    return wrap
