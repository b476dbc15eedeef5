"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the five ASCII controls tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of a row group of tables between stages.
ROW_GROUP = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset and all run in one process, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    Row groups are small, as writers and readers of long binary values hold them whole.
    """
    path = f"{shared_dir(df.sparkSession)}/tessera/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    made = _made.get()
    if made is not None:
        made.append(out)
    return out


#: The tables written by the run that this thread is in; other threads and runs have their own.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def own_tables() -> Iterator[list[DataFrame]]:
    """A list of what materialize() writes inside; of a run within a run each has its own."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def release(df: DataFrame | None) -> None:
    """Delete what materialize() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        df._tessera_path = None
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Groups that a task takes one after the other. Each task writes files, and each file in a local folder forks the executor for a moment.
GROUPS_A_TASK = 16


def by_group(df: DataFrame, key: str, groups: int):
    """Grouped by key, in as many tasks as the number of groups asks for: a task's share stays the same at every size."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(groups // GROUPS_A_TASK, min(groups, 2 * cores)), key).groupBy(key)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; a null text is an empty one."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], most_bytes: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about most_bytes of text (a single longer row stays whole)."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def crc32_of(column) -> F.Column:
    """Unsigned CRC-32 of a string's UTF-8 bytes."""
    return F.crc32(F.encode(F.coalesce(column, F.lit("")), "UTF-8"))
