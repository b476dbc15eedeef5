"""Micro-batches of records into versioned snapshots, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.joins import latest_per_key, upsert
from tessera.operators.stages import kept

RECORD = "source_system string, citation string, snapshot_date date, body string, status string"
STATUSES = ("approved", "proposed", "repealed", "withdrawn")


def validated(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad with the reason): one bad record doesn't stop a batch."""
    why = F.when(F.col("citation").isNull() | (F.trim("citation") == ""), "citation").when(F.col("snapshot_date").isNull(), "date").when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status").when(F.col("body").isNull(), "body")
    df = records.withColumn("reason", why)
    return df.where("reason is null").drop("reason"), df.where("reason is not null")


def changed(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records with state new, changed or unchanged against the latest stored version, and that version's date."""
    last = latest_per_key(stored, ["source_system", "citation"], [F.desc("snapshot_date")]).select("source_system", "citation", F.col("content_hash").alias("old_hash"), F.col("snapshot_date").alias("prior_date"))
    df = records.withColumn("content_hash", F.sha2("body", 256)).join(last, ["source_system", "citation"], "left")
    return df.withColumn("state", F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("changed")).drop("old_hash")


def ingest(spark: SparkSession, landing: str, store: str, checkpoint: str) -> dict[str, int]:
    """Take what has landed since the last run (the checkpoint is the cursor) and append new and changed versions.

    Each micro-batch writes the folder store/version=N; a batch that is run again
    after a failure overwrites its own folder, so nothing is stored twice.
    """
    counts = {"new": 0, "changed": 0, "unchanged": 0, "rejected": 0}
    schema = f"{RECORD}, content_hash string, prior_date date, state string"

    def put(batch: DataFrame, n: int) -> None:
        good, bad = validated(batch)
        good = latest_per_key(good, ["source_system", "citation"], [F.desc("snapshot_date"), F.desc("body")])
        good = kept(good)
        keys = good.select("source_system", "citation").distinct()
        stored = read_store(batch.sparkSession, store, schema).where(F.col("version") < n).join(keys, ["source_system", "citation"], "left_semi")
        found = kept(changed(good, stored))
        found.where("state <> 'unchanged'").write.mode("overwrite").parquet(f"{store}/version={n}")
        bad.write.mode("overwrite").parquet(f"{store}_rejected/version={n}")
        for r in found.groupBy("state").count().collect():
            counts[r["state"]] += r["count"]
        counts["rejected"] += bad.count()

    stream = spark.readStream.schema(RECORD).json(landing)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return counts


def read_store(spark: SparkSession, store: str, schema: str | None = None) -> DataFrame:
    """All versions; empty where nothing has been stored."""
    schema = schema or f"{RECORD}, content_hash string, prior_date date, state string"
    try:
        return spark.read.schema(f"{schema}, version int").parquet(store)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, version int")


def distinct_events(events: DataFrame, key: str, at: str, late: str = "2 days") -> DataFrame:
    """Events once each, with state that a watermark bounds."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and key, final once the watermark has passed."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))


def restitched(unlinked: DataFrame, actions: DataFrame, links: DataFrame) -> DataFrame:
    """Links after a batch: sections that had none may have an action now; those linked before keep theirs."""
    found = unlinked.join(actions.select("citation", "action_id", "published"), "citation").where(F.datediff("snapshot_date", "published").between(-7, 365))
    best = latest_per_key(found, ["citation"], [F.desc("published"), F.asc("action_id")]).select("citation", "action_id")
    return upsert(links, best, ["citation"], keep_old=True)
