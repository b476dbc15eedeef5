"""Vector codes: product quantisation over distinct parts with their weights.

Every vector is cut into parts. Equal integer parts of a position become one row
with the number of vectors that have it, and Lloyd's rounds run over these
weighted rows alone: the nearest entry of the position's codebook, then the
weighted sums of each entry. At last the codes and errors of the distinct parts
are joined back to the vectors.

A task adds up what it has for each entry, so at most (positions x entries) rows
reach the driver. Parts that more than one in HEAVY vectors has are at most HEAVY
x positions: they are joined by broadcast and the others by shuffle, so a part
that a third of all vectors has doesn't meet in one task.

Cases: vectors that are null, have another number of components, or null or
non-finite ones are dropped; repeated rows count as often as they occur and each
have their code; null vec_ids are coded like others and come last where the
codebooks start; of rows with one vec_id the smaller vector comes first; with
fewer vectors than entries there are fewer entries; of equally near entries the
lower index wins; null labels are one label; an empty table gives an empty one;
only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release
from tessera.llm.vectors import floor_means, integers, matrix, pieces, whole

#: One in so many vectors makes a part a heavy one; distinct parts that are compared at once.
HEAVY, ROWS = 1000, 4096


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each part."""
    d = ((parts[:, None, :] - book[None]) ** 2).sum(2)
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at]


def coded(b: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, part, code, error) of the rows (position, part, ...) of a batch."""
    position, part = b.column(0).to_numpy(), matrix(b.column(1))
    code, error = np.zeros(len(position), "i8"), np.zeros(len(position), "i8")
    for p in np.unique(position):
        at = np.flatnonzero(position == p)
        code[at], error[at] = nearest(part[at], books[p])
    return position, part, code, error


def sums_of(distinct: DataFrame, books: np.ndarray) -> list:
    """(position, code, weight, weighted sums) of every entry that is the nearest of some part."""
    positions, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(positions * entries, "i8"), np.zeros((positions * entries, width), "i8")
        for b in pieces(batches, ROWS):
            position, part, code, _ = coded(b, books)
            weight, entry = b.column(2).to_numpy(), position * entries + code
            np.add.at(n, entry, weight)
            np.add.at(sums, entry, part * weight[:, None])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used // entries, pa.int32()), pa.array(used % entries, pa.int32()), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["position", "code", "n", "sums"])

    parts = distinct.select("position", "part", "weight").mapInArrow(run, "position int, code int, n long, sums array<long>")
    return parts.groupBy("position", "code").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect()


def codes_of(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(position, part, weight, code, error) of every distinct part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, ROWS):
            _, _, code, error = coded(b, books)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code), pa.array(error)], names=["position", "part", "weight", "code", "error"])

    return distinct.select("position", "part", "weight").mapInArrow(run, "position int, part array<long>, weight long, code long, error long")


def joined_back(rows: DataFrame, codes: DataFrame, n: int, positions: int) -> DataFrame:
    """(row, vec_id, label, words, error): the codes of a vector's parts, eight to a word."""
    key, heavy = ["position", "part"], F.col("weight") * HEAVY > n
    parts = rows.select("row", "vec_id", "label", F.posexplode("parts").alias("position", "part"))
    some = parts.join(F.broadcast(codes.where(heavy).drop("weight")), key, "left")
    rest = some.where("code is null").drop("code", "error").join(codes.where(~heavy).drop("weight"), key)
    all_parts = some.where("code is not null").unionByName(rest)
    at = lambda w: F.when(F.expr(f"position div 8 = {w}"), F.expr("shiftleft(code, 8 * (7 - position % 8))"))
    return all_parts.groupBy("row", "vec_id", "label").agg(F.array(*[F.bit_or(at(w)) for w in range(positions // 8)]).alias("words"), F.sum("error").alias("error"))


def encode(vectors: DataFrame, positions: int = 16, entries: int = 64, rounds: int = 2, dim: int = 64) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that counts. Entries: 256 at most; positions: a multiple of 8."""
    spark, width = vectors.sparkSession, dim // positions
    cut = F.transform(F.sequence(F.lit(0), F.lit(positions - 1)), lambda i: F.slice("v", i * width + 1, width))
    kept = vectors.where(whole(dim)).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "label", integers().alias("v"))
    rows = materialize(kept.withColumn("parts", cut).drop("v"))
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()  # as many rows as entries
    if not start:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = np.array([r.parts for r in start], "i8").transpose(1, 0, 2).copy()
    each = rows.select(F.posexplode("parts").alias("position", "part"))
    distinct = materialize(each.groupBy("position", "part").agg(F.count("*").alias("weight")))
    for _ in range(rounds):
        for r in sums_of(distinct, books):
            books[r.position, r.code] = floor_means(r.sums, r.n)
    codes = materialize(codes_of(distinct, books))
    found = materialize(joined_back(rows, codes, rows.count(), positions))
    for df in (rows, distinct, codes):
        release(df)
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.lower(F.concat(*[F.lpad(F.hex(F.col("words")[w]), 16, "0") for w in range(positions // 8)]))
    return found.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
