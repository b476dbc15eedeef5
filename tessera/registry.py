"""The queries by name, each with the SQL that an oracle can run on the same tables, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register f(t, spark) under name; t(table) reads a table of the folder that is queried."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add
