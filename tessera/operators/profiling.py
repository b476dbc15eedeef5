"""Column profiles, keys and guarded checks over data sets."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of a column are listed only if it has at most so many; so many of them, and so many rows of a failed check.
LISTED, TOP, SAMPLE = 50, 10, 20
KEY_SUFFIXES = ("_id", "_serial", "key")


def unpivoted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value as string) of every cell."""
    columns = columns or df.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, nulls, exact distinct values, minimum and maximum (as text) of each column."""
    return unpivoted(df, columns).groupBy("column_name").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.countDistinct("value").alias("n_distinct"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def top_values(df: DataFrame, columns: list[str], listed: int = LISTED, top: int = TOP) -> DataFrame:
    """The most frequent values of the columns that have few."""
    counts = unpivoted(df, columns).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("column_name")
    ranked = counts.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "value"))).withColumn("_d", F.count("*").over(by))
    return ranked.where((F.col("_d") <= listed) & (F.col("rank") <= top)).drop("_d")


def primary_key(df: DataFrame) -> str | None:
    """The first column named like a key that is unique and never null."""
    named = [c for c in df.columns if c.lower().endswith(KEY_SUFFIXES)]
    if not named:
        return None
    found = df.agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(c) for c in named]).first()
    return next((c for c in named if found[c] == found["n"] > 0), None)


def containment(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """How many of a column's distinct values another table's key has: (n_values, n_matched, ratio)."""
    values = child.select(F.col(column).alias("v")).where("v is not null").distinct()
    keys = parent.select(F.col(key).alias("v")).distinct().withColumn("hit", F.lit(1))
    return values.join(keys, "v", "left").agg(F.count("*").alias("n_values"), F.count("hit").alias("n_matched"), F.round(F.count("hit") / F.count("*"), 6).alias("ratio"))


#: Words that a check must not contain.
BANNED = ("insert", "update", "delete", "drop", "create", "alter", "attach", "copy", "pragma", "install", "load", "export")


def refuse(sql: str) -> str | None:
    """Why a check's SQL isn't run, or None: one statement, SELECT or WITH first, none of the banned words."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", sql.strip().rstrip(";"))
    if ";" in bare:
        return "more than one statement"
    if not re.match(r"(?i)(select|with)\b", bare):
        return "neither SELECT nor WITH"
    return next((f"contains {w}" for w in BANNED if re.search(rf"(?i)\b{w}\b", bare)), None)


def run_check(spark: SparkSession, sql: str, args: dict | None = None, sample: int = SAMPLE, timeout_s: float = 30.0, **tables: DataFrame) -> dict:
    """Count and sample the violations that a SELECT finds; parameters are bound, never spliced in. tables: what the SQL names in braces, so that runs of one session don't share views."""
    import threading

    if why := refuse(sql):
        return {"status": "refused", "reason": why, "n": None, "sample": [], "seconds": 0.0}
    began, tag = time.time(), f"check-{threading.get_ident()}-{time.time_ns()}"
    timer = threading.Timer(timeout_s, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        found = spark.sql(sql, args=args or {}, **tables)
        n, rows = found.count(), [r.asDict() for r in found.limit(sample).collect()]
        return {"status": "violations" if n else "ok", "reason": None, "n": n, "sample": rows, "seconds": time.time() - began}
    except Exception as e:  # a broken check is a result, not the end of the run
        return {"status": "error", "reason": str(e).splitlines()[0][:300], "n": None, "sample": [], "seconds": time.time() - began}
    finally:
        timer.cancel()
        spark.removeTag(tag)


def validate_checks(spark: SparkSession, checks: list[dict], values: DataFrame, **tables: DataFrame) -> list[dict]:
    """(name, status, n, reason) of proposed checks, held against tables that are known to be right: a check is valid if all its parameters are bound by a document's values and it finds nothing.

    checks: name, sql with :parameters and the tables in braces, bindings (parameter:
    name of a value), a few at a time; values: name, value (number). Parameters
    that no value binds, refused SQL and errors leave a check unbound, refused or
    an error; none stops the others.
    """
    wanted = sorted({v for c in checks for v in c["bindings"].values()})
    held = {r["name"]: r["value"] for r in values.where(F.col("name").isin(wanted)).groupBy("name").agg(F.min("value").alias("value")).collect()}  # a row a binding
    out = []
    for c in checks:
        asked = set(re.findall(r"(?<!:):([A-Za-z_]\w*)", c["sql"]))
        args = {p: held.get(v) for p, v in c["bindings"].items()}
        missing = sorted(asked - {p for p, v in args.items() if v is not None})
        if missing:
            out.append({"name": c["name"], "status": "unbound", "n": None, "reason": f"no value for {', '.join(missing)}"})
            continue
        found = run_check(spark, c["sql"], {p: args[p] for p in asked}, **tables)
        status = {"ok": "valid", "violations": "invalid"}.get(found["status"], found["status"])
        out.append({"name": c["name"], "status": status, "n": found["n"], "reason": found["reason"]})
    return out


def assert_empty(name: str, violations: DataFrame) -> DataFrame:
    """(check, n_violations, passed) of one assertion."""
    return violations.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check_name"), "n_violations", (F.col("n_violations") == 0).alias("passed"))
