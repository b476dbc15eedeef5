"""Which columns hold the values of which others: one pass over all columns of all tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

from tessera.operators.profiling import KEY_SUFFIXES, unpivoted
from tessera.operators.stages import kept

#: Shapes of clause ids.
CLAUSE_SHAPES = r"^(\d+(\.\d+){0,2}[a-z]?|App-[A-Z]\.\d+|S\d+\.\d+)$"


def values_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(col, v, n): the distinct values of every plain column, hashed, and how often each occurs. col is table.column."""

    def one(name: str, df: DataFrame) -> DataFrame:
        plain = [f.name for f in df.schema if not isinstance(f.dataType, ArrayType | MapType | StructType | BinaryType)]
        cells = unpivoted(df.select(*[F.col(f"`{c}`") for c in plain]), plain).where("value is not null")
        return cells.select(F.concat(F.lit(f"{name}."), "column_name").alias("col"), F.xxhash64("value").alias("v"), F.col("value").rlike(CLAUSE_SHAPES).alias("shaped"))

    cells = reduce(DataFrame.unionByName, [one(name, df) for name, df in tables.items()])
    return cells.groupBy("col", "v").agg(F.count("*").alias("n"), F.first("shaped").alias("shaped"))


def inclusions(tables: dict[str, DataFrame], least: float = 0.9) -> DataFrame:
    """(child, parent, n_values, n_matched, ratio, parent_unique, named): pairs of columns of different tables where at least this share of the child's distinct values is in the parent.

    Values are inverted once: each with the list of columns that have it (as many
    as there are columns at most), whose pairs are counted. A value that a third
    of all rows has is one row by then. named: the child's name ends like the
    parent's, which is a key's.
    """
    values = kept(values_of(tables))
    sizes = values.groupBy("col").agg(F.count("*").alias("n_values"), F.max("n").alias("most"))
    held = values.groupBy("v").agg(F.collect_set("col").alias("cols")).where(F.size("cols") > 1)
    pairs = held.select(F.explode("cols").alias("child"), "cols").select("child", F.explode("cols").alias("parent"))
    table = lambda c: F.substring_index(c, ".", 1)
    counts = pairs.where(table("child") != table("parent")).groupBy("child", "parent").agg(F.count("*").alias("n_matched"))
    small = F.broadcast(sizes)  # a row a column
    found = counts.join(small.select(F.col("col").alias("child"), "n_values"), "child").join(small.select(F.col("col").alias("parent"), (F.col("most") == 1).alias("parent_unique")), "parent")
    bare = lambda c: F.regexp_replace(F.lower(F.substring_index(c, ".", -1)), r"^[a-z]_", "")
    named = bare("child").endswith(bare("parent")) & bare("parent").rlike(f"({'|'.join(KEY_SUFFIXES)})$")
    out = found.withColumn("ratio", F.col("n_matched") / F.col("n_values")).where(F.col("ratio") >= least)
    return out.select("child", "parent", "n_values", "n_matched", F.round("ratio", 6).alias("ratio"), "parent_unique", named.alias("named"))


def foreign_keys(found: DataFrame) -> DataFrame:
    """(child, parent, ratio): of the inclusions those in a unique key of a fitting name; of several parents the first by name."""
    return found.where("named and parent_unique").groupBy("child").agg(F.min_by(F.struct("parent", "ratio"), "parent").alias("m")).select("child", "m.parent", "m.ratio")


def reference_columns(table: str, df: DataFrame, ids: DataFrame, shaped: float = 0.9, known: float = 0.8) -> DataFrame:
    """(col, doc_id, shaped, known): columns whose values are shaped like clause ids and are the ids of one document's clauses; ids: doc_id, local_id."""
    values = values_of({table: df})
    form = values.groupBy("col").agg(F.count("*").alias("n_values"), F.count_if("shaped").alias("n_shaped")).where(F.col("n_shaped") >= shaped * F.col("n_values"))
    asked = values.join(F.broadcast(form), "col")
    hits = asked.join(ids.select("doc_id", F.xxhash64(F.col("local_id").cast("string")).alias("v")).distinct(), "v").groupBy("col", "doc_id", "n_values", "n_shaped").agg(F.count("*").alias("n_known"))
    return hits.where(F.col("n_known") >= known * F.col("n_values")).select("col", "doc_id", F.round(F.col("n_shaped") / F.col("n_values"), 6).alias("shaped"), F.round(F.col("n_known") / F.col("n_values"), 6).alias("known"))


def primary_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, key_name): of every table the first column named like a key that is unique and never null, or null; from the one pass over all values and a count of each table."""
    named = {name: [c for c in df.columns if c.lower().endswith(KEY_SUFFIXES)] for name, df in tables.items()}
    values = values_of({name: df.select(*named[name]) for name, df in tables.items() if named[name]})
    sizes = reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")) for name, df in tables.items()])
    place = F.create_map(*[F.lit(x) for name, columns in named.items() for i, c in enumerate(columns) for x in (f"{name}.{c}", i)]) if any(named.values()) else F.lit(None)
    counts = values.groupBy("col").agg(F.sum("n").alias("held"), F.max("n").alias("most")).where("most = 1").withColumn("table_name", F.substring_index("col", ".", 1)).withColumn("place", place[F.col("col")])
    keys = counts.join(sizes, "table_name").where("held = n_rows").groupBy("table_name").agg(F.min_by(F.substring_index("col", ".", -1), "place").alias("key_name"))
    return sizes.select("table_name").join(keys, "table_name", "left")
