"""Change detection and stitching as streams with state: nothing that is stored is read again."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is kept of a key: its latest snapshot's hash and time, how many versions it has, and whether it was told stale.
STATE = "content_hash string, at timestamp, n_versions long"
#: Keys whose state lies together in one row of it where there are no timers, by the hash of the key: calls to the store are made once for them all. Fixed for a checkpoint.
GROUPS = 4096
CHANGES = "source_system string, citation string, record_id string, at timestamp, content_hash string, state string, prior_at timestamp, n_versions long"


@contextmanager
def rocks(spark: SparkSession, **more: str) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, so that it needn't fit into memory; joins have one store for both sides, a batch stores what it changed, and rows of state aren't counted, which reads each key before it is written."""
    store = "spark.sql.streaming.stateStore.rocksdb."
    conf = {PROVIDER: ROCKS, "spark.sql.streaming.join.stateFormatVersion": "3", f"{store}changelogCheckpointing.enabled": "true", f"{store}trackTotalNumberOfRows": "false"} | more
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Versions(StatefulProcessor):
    """new, changed or unchanged for each record against the latest snapshot of its key, by one row of state.

    A micro-batch's records of a key are taken by time, then id. One that comes
    late is held against the latest snapshot too, but doesn't replace it. Where
    stale_days is given and no snapshot follows for so long, a timer tells the key
    stale, once for each latest snapshot.
    """

    def __init__(self, stale_days: int | None = None):
        self.stale_days = stale_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", STATE)

    def held(self) -> tuple | None:
        """The key's row of state; times there have no zone and are the worker's own."""
        row = self.latest.get()
        return row and (row[0], row[1].astimezone(UTC), row[2])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # rows and no frames: a key has few rows at a time, and a frame for each key takes longer than all else
        held = self.held()
        for r in sorted(rows, key=lambda r: (r["at"], r["record_id"])):
            at, content = r["at"].astimezone(UTC), r["content_hash"]
            if held is None:
                state, prior = "new", None
            else:
                state, prior = "unchanged" if held[0] == content else "changed", held[1]
            n = (held[2] if held else 0) + (state != "unchanged")
            yield told(*key, r["record_id"], at, content, state, prior, n)
            held = (held[0], held[1], n) if held and at < held[1] else (content, at, n)
        self.latest.update(held)
        if self.stale_days is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int((held[1] + timedelta(days=self.stale_days)).timestamp() * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held()
        yield told(*key, None, datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC), held[0], "stale", held[1], held[2])

    def close(self) -> None:
        pass


KEY = ["source_system", "citation"]


class GroupedVersions(StatefulProcessor):
    """What Versions tells, without timers, for a group of keys at once: columns of their records against columns of what is known of them. Times are microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "held binary")

    def handleInputRows(self, key: tuple, frames: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.latest.get()
        known = pa.ipc.open_stream(bytes(held[0])).read_pandas() if held else None
        out, known = told_at_once(pd.concat(list(frames), ignore_index=True), known)
        table = pa.Table.from_pandas(known, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.latest.update((sink.getvalue().to_pybytes(),))
        yield out

    def close(self) -> None:
        pass


def told_at_once(rows: pd.DataFrame, known: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(what is told of records, what is known after them). known: the key, content_hash, at, n_versions.

    A key's records are taken by time, then id. Those before its latest snapshot
    come first and are held against it; each other one is held against the one before.
    """
    m = 0 if known is None else len(known)
    keys = rows[KEY] if known is None else pd.concat([known[KEY], rows[KEY]], ignore_index=True)
    of = keys.groupby(KEY, dropna=False, sort=False).ngroup().to_numpy()
    size = of.max() + 1
    there, at0, content0, n0 = np.zeros(size, bool), np.zeros(size, "i8"), np.full(size, None, object), np.zeros(size, "i8")
    if known is not None:
        there[of[:m]], at0[of[:m]], content0[of[:m]], n0[of[:m]] = True, known["at"], known["content_hash"], known["n_versions"]
    rows = rows.assign(of=of[m:]).sort_values(["of", "at", "record_id"], ignore_index=True)
    g, at, content = rows["of"].to_numpy(), rows["at"].to_numpy(), rows["content_hash"].to_numpy(object)
    first, last = np.append(True, g[1:] != g[:-1]), np.append(g[1:] != g[:-1], True)
    late = there[g] & (at < at0[g])
    by_known = first | late | np.append(False, late[:-1])
    prior, old = np.where(by_known, at0[g], np.roll(at, 1)), np.where(by_known, content0[g], np.roll(content, 1))
    new = first & ~there[g]
    state = np.where(new, "new", np.where(old == content, "unchanged", "changed"))
    counted = np.cumsum(state != "unchanged")
    n = n0[g] + counted - (counted - (state != "unchanged"))[first][np.cumsum(first) - 1]
    out = rows[[*KEY, "record_id", "at", "content_hash"]].assign(state=state, prior_at=pd.array(prior, "Int64"), n_versions=n)
    out.loc[new, "prior_at"] = pd.NA
    on = last & ~late
    at0[g[on]], content0[g[on]], n0[g[last]] = at[on], content[on], n[last]
    return out, keys.drop_duplicates(ignore_index=True).assign(content_hash=content0, at=at0, n_versions=n0)


told = Row(*[c.split()[0] for c in CHANGES.split(", ")])


def changes(records: DataFrame, late: str = "30 days", stale_days: int | None = None) -> DataFrame:
    """(source_system, citation, record_id, at, content_hash, state, prior_at, n_versions) of a stream of records with these first four columns and a body.

    Bodies are hashed before they are shuffled. late: how far the watermark stays
    behind; it only decides when timers fire, no record is dropped.
    """
    keyed = records.withWatermark("at", late).select("source_system", "citation", "record_id", "at", F.sha2(F.coalesce("body", F.lit("")), 256).alias("content_hash"))
    if stale_days is not None:
        return keyed.groupBy(*KEY).transformWithState(Versions(stale_days), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
    group = F.pmod(F.xxhash64(*KEY), F.lit(GROUPS)).cast("int").alias("group")
    grouped = keyed.select(group, *KEY, "record_id", F.unix_micros("at").alias("at"), "content_hash").groupBy("group")
    found = grouped.transformWithStateInPandas(GroupedVersions(), outputStructType=CHANGES.replace("timestamp", "long"), outputMode="Append", timeMode="None")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("at", "prior_at")})


def stitched(sections: DataFrame, actions: DataFrame, late: str = "10 days", before: int = 7, after: int = 365) -> DataFrame:
    """(section_id, action_id, published) of sections and actions with one citation, whichever comes first.

    Sections have (section_id, citation, at), actions (action_id, citation,
    published). A section's time lies from ``before`` days before to ``after`` days
    after the action's. Each side waits in state until the other's watermark has
    passed its interval.
    """
    s = sections.withWatermark("at", late).alias("s")
    a = actions.withWatermark("published", late).alias("a")
    near = F.expr(f"s.at >= a.published - interval {before} days and s.at <= a.published + interval {after} days")
    return s.join(a, (F.col("s.citation") == F.col("a.citation")) & near).select("s.section_id", "a.action_id", "a.published")


def take(stream: DataFrame, path: str, checkpoint: str, timers: bool = True) -> None:
    """Run a stream over all that has landed since the checkpoint, appending to a Parquet folder.

    Without timers there is no batch after the last data: it would tell nothing,
    and what has expired by then goes with the next data.
    """
    with rocks(stream.sparkSession, **{"spark.sql.streaming.noDataMicroBatches.enabled": str(timers).lower()}):
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
