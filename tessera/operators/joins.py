"""Joins that Spark has no word for, as equi-joins, windows and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (ties are the caller's to break)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def earliest_rows(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows at their key's earliest date: a semi-join on both columns."""
    first = df.groupBy(key).agg(F.min(at).alias(at))
    return df.join(first, [key, at], "left_semi")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, carry: list[str], forward: bool = False, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every left row with the last right row at or before its time (forward: the first at or after it).

    One union, one window by key: no row meets more than its neighbours, so that a
    key with many rows costs a sort and not a product of both sides. carry: the
    right columns to bring, null where there is none. bucket: a rising function
    of the time, by which keys with very many rows are split; what a bucket
    doesn't find comes from the last row of the buckets before it, of which each
    has one row a key.
    """
    struct = F.struct(F.col(right_at).alias("_at"), *[F.col(c) for c in carry])
    of = bucket or (lambda _: F.lit(0))
    l = left.select(*keys, F.col(left_at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    r = right.select(*keys, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), struct.alias("_hit"))
    l, r = (df.withColumn("_b", of(F.col("_t"))) for df in (l, r))
    order = [F.col("_t").desc(), F.col("_side")] if forward else [F.col("_t"), F.col("_side")]
    w = Window.partitionBy(*keys, "_b").orderBy(*order, *[F.col(f"_hit.{c}") for c in carry])
    last = F.last("_hit", ignorenulls=True)
    found = l.unionByName(r, allowMissingColumns=True).withColumn("_last", last.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_side = 1")
    if bucket:
        ends = r.withColumn("_end", last.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(*keys, "_b", "_end").distinct()
        cells = l.select(*keys, "_b", F.lit(None).cast(ends.schema["_end"].dataType).alias("_end")).distinct().unionByName(ends).groupBy(*keys, "_b").agg(F.first("_end", ignorenulls=True).alias("_end"))
        before = Window.partitionBy(*keys).orderBy(F.col("_b").desc() if forward else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
        carried = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_c"), F.last("_end", ignorenulls=True).over(before).alias("_before"))
        on = F.col("_b").eqNullSafe(F.col("_c"))
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        found = found.join(carried, on, "left").withColumn("_last", F.coalesce("_last", "_before"))
    return found.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in carry])


def band_join(a: DataFrame, b: DataFrame, a_day: str, b_day: str, days: int, residual: Column, on: Column | None = None) -> DataFrame:
    """Pairs at most ``days`` apart: both sides in buckets of that width, one side in its neighbours' too."""
    width = F.lit(days + 1)
    left = a.withColumn("_b", F.floor(F.datediff(F.col(a_day), F.lit("1970-01-01")) / width))
    right = b.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.datediff(F.col(b_day), F.lit("1970-01-01")) / width) + d)))
    near = F.abs(F.datediff(F.col(a_day), F.col(b_day))) <= days
    on = near & residual if on is None else near & residual & on
    return left.alias("l").join(right.alias("r"), (F.col("l._b") == F.col("r._b")) & on).drop("_b")


def nearest(df: DataFrame, keys: list[str], at: str, target: Column, carry: str) -> DataFrame:
    """Each key's row nearest to a date; the earlier one of a tie."""
    return df.groupBy(*keys).agg(F.min_by(carry, F.struct(F.abs(F.datediff(at, target)), at, carry)).alias(carry))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], keep_old: bool = False) -> DataFrame:
    """stored with new rows merged in by key: new ones replace (or, with keep_old, yield to) stored ones."""
    rank = F.lit(0) if keep_old else F.lit(1)
    both = stored.withColumn("_p", rank).unionByName(new.withColumn("_p", F.lit(1) - rank))
    return latest_per_key(both, keys, [F.col("_p")]).drop("_p")


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with what is wrong with them: missing, unexpected or changed."""
    e = expected.select(*keys, F.struct(*values).alias("_e"))
    a = actual.select(*keys, F.struct(*values).alias("_a"))
    both = e.join(a, keys, "full_outer")
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(~F.col("_e").eqNullSafe(F.col("_a")), "changed")
    return both.select(*keys, state.alias("state")).where("state is not null")


def neighbours(edges: DataFrame, src: str, dst: str, loops: bool = False) -> DataFrame:
    """Edges in both directions, once each; links of a node with itself only where ``loops`` asks for them."""
    both = edges.select(F.col(src).alias("node"), F.col(dst).alias("other")).unionByName(edges.select(F.col(dst).alias("node"), F.col(src).alias("other")))
    return (both if loops else both.where("node <> other")).distinct()


def match_in_order(a: DataFrame, b: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a and b one to one: of each key's rows the n-th of a with the n-th of b, as structs a and b beside the keys."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    side = lambda df, name: df.withColumn("_n", nth).select(*keys, "_n", F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    return side(a, "a").join(side(b, "b"), [*keys, "_n"]).drop("_n")


def merged_maps(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """One map a key: all its rows' maps put into each other in order, later values of a name in the place of earlier ones; a null value takes a name out again. Merging is the last value of each name, so a key of very many rows is aggregated before it meets."""
    cells = df.select(*keys, F.struct(*order).alias("_at"), F.explode(column).alias("_name", "_value"))
    last = cells.groupBy(*keys, "_name").agg(F.max_by(F.struct("_value"), "_at").alias("_last")).where("_last._value is not null")
    filled = last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_last._value")))).alias(column))
    empty = F.create_map().cast(df.schema[column].dataType)
    return df.select(*keys).distinct().join(filled, keys, "left").select(*keys, F.coalesce(column, empty).alias(column))


def tree(ids: DataFrame, key: str) -> DataFrame:
    """(key, parent_id, depth) of dotted ids: the longest prefix that is an id too, and how many prefixes are."""
    parts = F.split(key, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    asked = ids.select(key, F.explode_outer(F.when(F.size(parts) > 1, above)).alias("above"))
    there = ids.select(F.col(key).alias("above"), F.lit(1).alias("there")).distinct()
    found = asked.join(there, "above", "left").where("there is not null or above is null or true")
    hit = F.when(F.col("there").isNotNull(), F.col("above"))
    return found.groupBy(key).agg(F.max_by(hit, F.when(F.col("there").isNotNull(), F.length("above"))).alias("parent_id"), F.count("there").alias("depth"))


def tree_filter(nodes: DataFrame, key: str, shown: Column, found: Column) -> DataFrame:
    """nodes of a tree by dotted ids: of those that may be shown the ones that are found, with everything above them; hit says which were found."""
    rows = nodes.where(F.coalesce(shown, F.lit(False))).withColumn("hit", F.coalesce(found, F.lit(False)))
    parts = F.split(key, r"\.")
    way = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    kept = rows.where("hit").select(F.explode(way).alias(key)).distinct()
    return rows.join(kept, key, "left_semi")


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """df with each row's place in a whole order, from 1: rows are dealt to partitions by ranges of the order, counted there, and each partition starts behind those before it. Only one count a partition meets in one task."""
    from tessera.operators.stages import kept

    parts = df.sparkSession.sparkContext.defaultParallelism if df.sparkSession.conf.get("spark.sql.shuffle.partitions", None) is None else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_k"))
    ahead = F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return own.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_own") + F.col("_ahead")).drop("_part", "_own", "_ahead")
