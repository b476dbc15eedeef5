"""k-means over integer vectors, with centroids screened by the norms of segments.

Each vector is cut into segments, whose norms are computed once and written with
it. As a product of two segments is at most the product of their norms
(Cauchy-Schwarz), the squared distance of a vector and a centroid is at least the
sum of the squared differences of their segments' norms. The centroid of the
least bound gets its exact distance first; of the others only those whose bound
isn't above it. Distances are exact integers, so bounds only spare work.

The vectors are written once and read again each round. A task adds up the
vectors of each centroid, so that at most (tasks x centroids) rows are shuffled
and one row a centroid reaches the driver.

Cases: vectors that are null, have another number of components, or null or
non-finite ones are dropped; repeated rows count as often as they occur; a null
vec_id is assigned like others, but starts a centroid only where too few others
are left; of rows with one vec_id the smaller vector starts first; with fewer
vectors than centroids there are fewer centroids; of equally near centroids the
smaller number wins; an empty table gives an empty one; only ``vec_id`` and
``embedding`` are read.
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

#: Segments of a vector; rows that are compared at once.
SEGMENTS, ROWS = 16, 1024
#: What rounding may add to a bound, as a share of the squared norms.
SLACK = 1e-9


class Screen:
    """The nearest of some centroids, by bounds first."""

    def __init__(self, centroids: np.ndarray, segments: int = SEGMENTS):
        self.centroids = centroids
        self.norms = np.sqrt((centroids.astype("f8").reshape(len(centroids), segments, -1) ** 2).sum(2))
        self.compared = 0

    def nearest(self, vectors: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, exact squared distance) for each vector."""
        rows = np.arange(len(vectors))
        bound = ((norms[:, None, :] - self.norms[None]) ** 2).sum(2)
        bound -= SLACK * ((norms**2).sum(1)[:, None] + (self.norms**2).sum(1)[None]) + 1
        first = bound.argmin(1)
        exact = np.full(bound.shape, np.iinfo("i8").max)
        exact[rows, first] = best = self.distances(vectors, first)
        bound[rows, first] = np.inf
        at, number = np.nonzero(bound <= best[:, None])
        exact[at, number] = self.distances(vectors[at], number)
        chosen = exact.argmin(1)
        return chosen, exact[rows, chosen]

    def distances(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        self.compared += len(numbers)
        return ((vectors - self.centroids[numbers]) ** 2).sum(1)


def with_norms(vectors: DataFrame, dim: int, segments: int) -> DataFrame:
    """(vec_id, v, norms) of what counts."""
    width = dim // segments
    square = lambda i: F.aggregate(F.slice("v", i * width + 1, width), F.lit(0).cast("long"), lambda a, x: a + x * x)
    norms = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.sqrt(square(i).cast("double")))
    return vectors.where(whole(dim)).select(F.col("vec_id").cast("long"), integers().alias("v")).withColumn("norms", norms)


def sums_of(kept: DataFrame, centroids: np.ndarray, segments: int) -> list:
    """(centroid, vectors, their sum) of every centroid that is the nearest of some."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, n, sums = Screen(centroids, segments), np.zeros(len(centroids), "i8"), np.zeros(centroids.shape, "i8")
        for b in pieces(batches, ROWS):
            v = matrix(b.column(0))
            number, _ = screen.nearest(v, matrix(b.column(1), "f8"))
            n += np.bincount(number, minlength=len(n))
            np.add.at(sums, number, v)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = kept.select("v", "norms").mapInArrow(run, "cluster int, n long, sums array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums")).collect()


def assigned(kept: DataFrame, centroids: np.ndarray, segments: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids, segments)
        for b in pieces(batches, ROWS):
            number, distance = screen.nearest(matrix(b.column(1)), matrix(b.column(2), "f8"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return kept.select("vec_id", "v", "norms").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: int = 2, dim: int = 64, segments: int = SEGMENTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts."""
    spark = vectors.sparkSession
    kept = materialize(with_norms(vectors, dim, segments))
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    start = kept.select("v", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    centroids = np.array([r.v for r in start], "i8").reshape(-1, dim)
    if len(centroids):
        for _ in range(rounds):
            for r in sums_of(kept, centroids, segments):
                centroids[r.cluster] = floor_means(r.sums, r.n)
        found = materialize(assigned(kept, centroids, segments))
    else:
        found = spark.createDataFrame([], "vec_id long, cluster int, distance long")
    release(kept)
    sums = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    told = [(c, d, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
