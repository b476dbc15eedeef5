"""SimHash near-duplicate groups with vantage-point trees.

A fingerprint within ``radius`` differing bits of another agrees with it on a
block of bits: 64 bits in m blocks leave at least m - radius of them untouched.
Each distinct fingerprint goes to a shard for every choice of m - radius blocks,
whose values name the shard; m grows with the number of fingerprints so that a
shard stays small. (A single tree over all fingerprints prunes next to nothing:
unrelated ones lie 32 +- 4 bits from any vantage point, so that three in four
lie within the radius of its median and belong to both sides.) Within a shard a
vantage-point tree splits the fingerprints at the median Hamming distance to a
vantage point, leaves out the branches that the triangle inequality rules out
and compares the points that lie within the radius of the boundary with the
other side's. Fingerprints within the radius of a vantage point are one group at
once, by which large groups of near copies don't cost all their pairs. Shards
give a spanning forest, never all pairs; components are then found over all.

Cases: null and empty texts have the fingerprint zero and link like any other;
shorter texts than a shingle are one shingle; repeated doc_ids share a
component by their fingerprints; a null doc_id is no group's smallest unless the
group has no other (then its component is null); other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, texts_of
from tessera.llm.components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Stands for a null doc_id where rows are joined.
NO_ID = 2**63 - 1
#: Fingerprints that a shard value should hold at most on average, a leaf of the tree, a task of shards.
VALUE_ROWS, LEAF, TASK_ROWS = 256, 256, 8192


def fingerprint(text: str, n: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        hashes = [digest(b" ".join(words), seed)]
    else:
        flat = b" ".join(words)
        starts = np.zeros(len(words) + 1, "int64")
        np.cumsum([len(w) + 1 for w in words], out=starts[1:])
        at = starts.tolist()
        hashes = [digest(flat[a:b], seed) for a, b in zip(at, [x - 1 for x in at[n:]], strict=False)]
    ones = np.zeros(BITS, "int64")
    packed = np.array(hashes, ">u8")
    for i in range(0, len(packed), 4096):
        ones += np.unpackbits(packed[i : i + 4096].view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in texts_of(b)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Disjoint sets over positions 0 to n - 1, and the edges that joined them."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.root[at]
        while True:
            up = self.root[r]
            if (up == r).all():
                self.root[at] = r
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i] for all i."""
        ra, rb = self.roots(a), self.roots(b)
        apart = np.flatnonzero(ra != rb)
        if len(apart) > 1:
            apart = apart[np.unique(ra[apart] * len(self.root) + rb[apart], return_index=True)[1]]
        for i in apart:
            x, y = self.find(a[i]), self.find(b[i])
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.edges.append((a[i], b[i]))


class VantagePoints:
    """Link all of the fingerprints that lie within the radius of each other, by a vantage-point tree."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius, self.forest = fps, radius, Forest(len(fps))

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every pair of a and b."""
        for i in range(0, len(a), 256):
            part = a[i : i + 256]
            for j in range(0, len(b), 4096):
                other = b[j : j + 4096]
                x, y = np.nonzero(np.bitwise_count(self.fps[part][:, None] ^ self.fps[other][None, :]) <= self.radius)
                if len(x):
                    self.forest.join(part[x], other[y])

    def one(self, at: np.ndarray) -> bool:
        """Whether these are one group already."""
        r = self.forest.roots(at)
        return bool((r == r[0]).all())

    def within(self, at: np.ndarray) -> None:
        todo = [at]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                if len(at) > 1:
                    self.compare(at, at)
                continue
            d = np.bitwise_count(self.fps[at] ^ self.fps[at[0]]).astype("int64")
            near = at[d <= self.radius]
            self.forest.join(near, np.full(len(near), at[0]))
            if self.one(at):
                continue
            mid = int(np.median(d))
            if mid >= d.max():
                mid -= 1
            todo += [at[d <= mid], at[d > mid]]
            self.between(at[(d <= mid) & (d > mid - self.radius)], at[(d > mid) & (d <= mid + self.radius)], 6)

    def between(self, a: np.ndarray, b: np.ndarray, depth: int) -> None:
        if not len(a) or not len(b) or self.one(np.concatenate([a, b])):
            return
        if len(a) * len(b) <= 16 * LEAF * LEAF or not depth:
            self.compare(a, b)
            return
        v = self.fps[a[0]]
        da, db = np.bitwise_count(self.fps[a] ^ v).astype("int64"), np.bitwise_count(self.fps[b] ^ v).astype("int64")
        for at, d in ((a, da), (b, db)):
            self.forest.join(at[d <= self.radius], np.full(int((d <= self.radius).sum()), a[0]))
        mid, r = int(np.median(np.concatenate([da, db]))), self.radius
        self.between(a[da <= mid], b[db <= mid], depth - 1)
        self.between(a[da > mid], b[db > mid], depth - 1)
        self.between(a[(da <= mid) & (da > mid - r)], b[(db > mid) & (db <= mid + r)], depth - 1)
        self.between(a[(da > mid) & (da <= mid + r)], b[(db <= mid) & (db > mid - r)], depth - 1)


def shard_edges(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Spanning edges (src, dst: representatives) of the values of one task's shards."""
    pdf = pdf.sort_values(["choice", "value"], kind="stable")
    choice, value, fps, reps = (pdf[c].to_numpy() for c in ("choice", "value", "fp", "rep"))
    fps = fps.view("u8")
    cuts = np.flatnonzero((choice[1:] != choice[:-1]) | (value[1:] != value[:-1])) + 1
    out: list[tuple[int, int]] = []
    for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
        if b - a > 1:
            if b - a <= 64:  # a leaf by itself, in which most have no pair at all
                hit = np.bitwise_count(fps[a:b, None] ^ fps[None, a:b]) <= radius
                if hit.sum() == b - a:
                    continue
            tree = VantagePoints(fps[a:b], radius)
            tree.within(np.arange(b - a))
            out += [(reps[a + x], reps[a + y]) for x, y in tree.forest.edges]
    return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")


def choices(n: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Bit masks, one of which any two fingerprints within the radius agree on; the more fingerprints, the finer."""
    for m in range(radius + 1, bits // 4):
        edges = [round(i * bits / m) for i in range(m + 1)]
        block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
        keep = m - radius
        if n >> (bits * keep // m) <= VALUE_ROWS or m == radius + 4:
            return [sum(c) for c in itertools.combinations(block, keep)]
    raise AssertionError


def near_links(reps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (src, dst) between the representatives of (fp, rep) rows with distinct fp that connect whatever lies within the radius."""
    masks = choices(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tasks = max(1, n * len(masks) // TASK_ROWS)
    keyed = reps.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("choice", "value"))
    keyed = keyed.withColumn("task", F.pmod(F.xxhash64("choice", "value"), F.lit(tasks)).cast("int"))
    return keyed.groupBy("task").applyInPandas(lambda pdf: shard_edges(pdf, radius), "src long, dst long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every document: component_id is the smallest doc_id that links of up to ``radius`` bits reach."""
    fps = materialize(fingerprints(docs, shingle))
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(near_links(reps, reps.count(), radius))
    of = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all of its columns.

    Documents without doc_id stay only where none of their group has one. Rows
    of one doc_id are one document only where their texts are in one group.
    """
    key, digest = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce("text", F.lit("")))
    # the digest goes through fingerprints() in place of doc_id: it tells which text a fingerprint is of
    fps = materialize(fingerprints(docs.select(digest.alias("doc_id"), "text"), shingle).select(F.col("doc_id").alias("_digest"), "fp").distinct())
    reps = materialize(fps.select("fp", F.col("fp").alias("rep")).distinct())
    found = connected_components(near_links(reps, reps.count(), radius))
    of = fps.join(found, fps["fp"] == found["node"], "left").select("_digest", F.coalesce("component", "fp").alias("_group"))
    keys = docs.groupBy(digest.alias("_digest")).agg(F.min(key).alias("_key"))
    keep = keys.join(of, "_digest").groupBy("_group").agg(F.min(F.struct("_key", "_digest")).alias("_first")).select("_first.*")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"), digest.alias("_digest")).join(keep, ["_key", "_digest"], "left_semi")
    return rows.groupBy("_key", "_digest").agg(F.first("_row").alias("_row")).select("_row.*")
