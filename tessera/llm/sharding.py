"""Consistent hashing with virtual nodes and bounded loads.

Shards stand on a ring of 2^60 places with ``vnodes`` points each; a document
belongs to the arc that its doc_id's hash falls into and goes to the shard whose
point ends the arc, clockwise. Shards have room for n/shards rows, rounded so
that the rooms add up to n (the first n mod shards take one more): what overflows
continues clockwise to the next shard that has room. So the law ``rows`` holds:
counts are at most one apart. Which rows of an arc overflow is fixed by their
place on the ring, ties by doc_id, checksum and size.

The driver only sees the number of rows of each arc (shards x vnodes numbers,
however large the table) and answers with quotas; rows find their place by
their rank within their arc. An arc holds about 1/(shards x vnodes) of all rows
whatever the texts are; a doc_id that is repeated without end would make its
arc as long, so the checksum of the text is part of the place where ``salted``.
Only wholly equal rows (one doc_id and one text) share a place, and so are ranked
by one task.

Cases: null texts count as empty; equal rows are separate rows, each with a
slot of its own; an empty table gives an empty result; a null doc_id is hashed
as the empty string; other columns are ignored.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import crc32_of

RING, LOOKUP = 60, 14


def ring_points(shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Places of the virtual nodes, ascending, and whose they are."""
    points = sorted({xxhash.xxh64_intdigest(f"{s}/{v}", 42) >> (64 - RING): s for s in range(shards) for v in range(vnodes)}.items())
    return [p for p, _ in points], [s for _, s in points]


def quotas(counts: dict[int, int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Who takes which ranks of an arc: (arc, from rank, to rank, shard, slot of the first).

    Every arc's own shard is served first, then what overflowed goes round the
    ring, arc after arc, until all have found room.
    """
    left, used = list(room), [0] * len(room)
    out: list[tuple[int, int, int, int, int]] = []
    over: list[tuple[int, int, int]] = []

    def give(arc: int, start: int, n: int, shard: int) -> int:
        take = min(n, left[shard])
        if take:
            out.append((arc, start, start + take, shard, used[shard]))
            left[shard] -= take
            used[shard] += take
        return take

    for arc in range(len(owner)):
        n = counts.get(arc, 0)
        took = give(arc, 0, n, owner[arc])
        if took < n:
            over.append((arc, took, n - took))
    for arc, start, n in over:
        step = 0
        while n:
            step += 1
            if step > len(owner):
                raise ValueError("the rooms are smaller than the rows")
            took = give(arc, start, n, owner[(arc + step) % len(owner)])
            start, n = start + took, n - took
    return out


def assign(docs: DataFrame, shards: int, vnodes: int = 128, salted: bool = True) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark = docs.sparkSession
    places, owner = ring_points(shards, vnodes)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        crc32_of(F.col("text")).alias("text_crc32"),
    )
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit(""))]
    ringed = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64(*key, *([F.col("text_crc32")] if salted else [])), 64 - RING))
    # an arc is found by the ring's 2^LOOKUP equal cells: each lists the arcs that it touches
    cells = []
    for c in range(1 << LOOKUP):
        lo, hi = c << (RING - LOOKUP), ((c + 1) << (RING - LOOKUP)) - 1
        for a in range(bisect.bisect_left(places, lo), bisect.bisect_left(places, hi) + 1):
            cells.append((c, max(lo, places[a - 1] + 1 if a else 0), min(hi, places[a]) if a < len(places) else hi, a % len(places)))
    arcs = F.broadcast(spark.createDataFrame(cells, "cell long, lo long, hi long, arc int"))
    placed = ringed.withColumn("cell", F.shiftrightunsigned("place", RING - LOOKUP)).join(arcs, "cell").where("place between lo and hi").drop("cell", "lo", "hi")
    counts = {r["arc"]: r["n"] for r in placed.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    given = F.broadcast(spark.createDataFrame(quotas(counts, owner, room), "arc int, start long, stop long, shard int, first_slot long"))
    rank = F.row_number().over(Window.partitionBy("arc").orderBy("place", "doc_id", "text_crc32", "size")) - 1
    ranked = placed.withColumn("rank", rank.cast("long"))
    return ranked.join(given, "arc").where("rank >= start and rank < stop").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first_slot") + F.col("rank") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
