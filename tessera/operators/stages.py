"""Stages that several later ones read: written once, so that they aren't computed anew for each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from tessera.sources.files import landing_dir


def kept(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder that driver and executors share, and read again."""
    path = landing_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, rows: int) -> int:
    """How many partitions hold about so many rows of df each, and at least what the session deals into: tasks don't grow with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / rows))


def spread(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df in as many partitions as there are cores and of about so many rows, where it has fewer: rows that Python works on long shouldn't wait in one task of a large file."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
