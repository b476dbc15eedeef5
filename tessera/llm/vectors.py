"""Vectors of exact integers, as the operators on embeddings share them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a component is multiplied by before it is rounded down, and the size it must stay below, as squared distances would leave 64 bits.
SCALE, LIMIT = 256, 2.0**19


def whole(dim: int) -> Column:
    """Whether a vector has dim components, none null or non-finite."""
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return (F.size("embedding") == dim) & ~bad


def integers() -> Column:
    """The components as integers; one that is too large is an error."""

    def one(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.abs(x) < LIMIT, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit(f"a component isn't below {LIMIT:.0f}")).cast("long"))

    return F.transform("embedding", one)


def matrix(column: pa.ListArray, dtype: str = "i8") -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def floor_means(sums: list[int], n: int) -> list[int]:
    return [s // n for s in sums]
