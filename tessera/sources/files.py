"""Files in and out: data sets, registers, documents with front matter, sections of XML and JSON, snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells that mean null, and the marks of the styles of front matter.
NULLS = ("", "NULL", "null", "None")
FRONT = (r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", r"(?s)\A<!--\s*\n?(.*?)\n?\s*-->\s*(?:\n|\z)", r"(?s)\A\+\+\+\s*\n(.*?)\n\+\+\+\s*(?:\n|\z)")
SNIFFED = ("bigint", "double", "timestamp", "boolean")


def landing_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which the driver and all executors share; of this machine only where all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/landing/{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, typed: dict[str, str] | None = None) -> DataFrame:
    """A CSV (or CSV.GZ) with four null tokens; one pass infers the columns that are not typed.

    Spark's reader takes one null token, so all cells are read as text first.
    A column is a number, timestamp or boolean if every cell that isn't null is.
    """
    raw = spark.read.csv(path, header=True, nullValue="", multiLine=True, escape='"')
    clean = raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*NULLS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    typed = dict(typed or {})
    asked = [c for c in clean.columns if c not in typed]
    if asked:
        counts = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(k).isNull()).alias(f"{i}_{k}") for i, c in enumerate(asked) for k in SNIFFED]
        some = [F.count(F.col(f"`{c}`")).alias(f"{i}_n") for i, c in enumerate(asked)]
        found = clean.agg(*counts, *some).first()
        for i, c in enumerate(asked):
            typed[c] = next((k for k in SNIFFED if found[f"{i}_n"] and not found[f"{i}_{k}"]), "string")
    return clean.select(*[F.col(f"`{c}`").try_cast(typed[c]).alias(c) for c in clean.columns])


def read_register(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A register: one row is one clause (id, cells, text); rows without an id are numbered by their content's hash."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    cells = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in raw.columns]), F.array(*[F.col(f"`{c}`") for c in raw.columns])), lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    lines = F.array_join(F.transform(F.map_entries(cells), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    missing = F.concat(F.lit("ROW_"), F.substring(F.sha2(F.concat_ws("\u001f", *[F.col(f"`{c}`") for c in raw.columns]), 256), 1, 12))
    return raw.select(F.coalesce(F.nullif(F.trim(F.col(f"`{key}`")), F.lit("")), missing).alias("clause_id"), cells.alias("row_cells"), lines.alias("text"))


def read_people(spark: SparkSession, path: str, lists: tuple[str, ...] = ("roles", "verticals")) -> DataFrame:
    """People of a CSV; cells of these columns are lists parted by semicolons, without blanks and empty parts."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(f"`{c}`"), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(*[parts(c).alias(c) if c in lists else F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns])


def read_attributes(spark: SparkSession, path: str, block: str = "applicability_attributes") -> DataFrame:
    """(path, key, value_text, value_num, value_bool) of a YAML block of plain keys: what is a truth value, else a number, else text."""
    held = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", rf"(?m)^{block}:[ \t]*\r?\n((?:[ \t]+.*(?:\r?\n|\z)|[ \t]*(?:#.*)?\r?\n)*)", 1).alias("body"))
    lines = held.select("path", F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^[ \t]+([\w.\-]+):[ \t]*(.*?)[ \t]*(?:[ \t]#.*)?\r?$"), F.lit(0))).alias("line"))
    raw = F.regexp_extract("line", r"^[ \t]+[\w.\-]+:[ \t]*(.*?)[ \t]*(?:[ \t]#.*)?\r?$", 1)
    quoted = raw.rlike("^(\".*\"|'.*')$")
    text = F.when(F.col("quoted"), F.expr("substring(raw, 2, length(raw) - 2)")).otherwise(F.col("raw"))
    truth = F.when(~F.col("quoted") & F.lower("raw").isin("true", "yes", "on"), True).when(~F.col("quoted") & F.lower("raw").isin("false", "no", "off"), False)
    df = lines.select("path", F.regexp_extract("line", r"^[ \t]+([\w.\-]+):", 1).alias("key"), raw.alias("raw"), quoted.alias("quoted")).withColumn("value_bool", truth)
    told = F.when(F.col("value_bool").isNotNull(), F.initcap(F.col("value_bool").cast("string"))).otherwise(text)
    return df.withColumn("value_text", told).select("path", "key", "value_text", F.when(F.col("value_bool").isNull(), F.col("value_text").try_cast("double")).alias("value_num"), "value_bool")


def write_report(stats: DataFrame, issues: DataFrame, checks: DataFrame, path: str, shown: int = 20) -> None:
    """One JSON document of a run: stats (name, n) as a map, issues (code, message) counted by code with some messages, checks (check_name, n_violations, passed) and whether all passed."""
    one = stats.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("stats"))
    by_code = issues.groupBy("code").agg(F.count("*").alias("n"), F.min("message").alias("first"))
    two = by_code.agg(F.slice(F.array_sort(F.collect_list(F.struct("code", "n", "first"))), 1, 1000).alias("issues"))
    three = checks.agg(F.array_sort(F.collect_list(F.struct("check_name", "n_violations", "passed"))).alias("checks"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))
    one.join(two).join(three).coalesce(1).write.mode("overwrite").json(path)  # a row each


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (SHA-1) of a string in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


#: Ids of registers' rows.
REGISTER_ID = r"^(OBL|EVT|RRS)-[A-Z0-9]+-\d+$"


def sniff_registers(spark: SparkSession, path: str) -> DataFrame:
    """(path, key_column, first_id, is_register) of every CSV file below a path: a register's first column ends in _id and its first value is a register's id. Only a file's first block is looked at."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value").where("block = 0").withColumn("at", F.monotonically_increasing_id())
    heads = lines.groupBy("path").agg(F.min("at").alias("first"), F.min_by("value", "at").alias("header"))
    rows = lines.join(heads, "path").where("at > first").groupBy("path", "header").agg(F.min_by("value", "at").alias("row"))
    cell = lambda c: F.regexp_replace(F.trim(F.substring_index(c, ",", 1)), '^"|"$', "")
    found = heads.select("path", "header").join(rows.select("path", "row"), "path", "left").select("path", cell("header").alias("key_column"), cell("row").alias("first_id"))
    return found.withColumn("is_register", F.lower("key_column").endswith("_id") & F.coalesce(F.col("first_id").rlike(REGISTER_ID), F.lit(False)))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Texts with front matter of any of three styles: (path, meta map, body, body_start in characters)."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    head, whole = F.lit(None).cast("string"), F.lit("")
    for style in FRONT:
        hit = F.regexp_extract("content", style, 0)
        head, whole = F.coalesce(head, F.nullif(F.regexp_extract("content", style, 1), F.lit(""))), F.when(whole == "", hit).otherwise(whole)
    pairs = F.transform(F.regexp_extract_all(F.coalesce(head, F.lit("")), F.lit(r"(?m)^([A-Za-z_][\w \-]*):[ \t]*(.*)$"), F.lit(0)), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("v")))
    meta = F.map_from_entries(F.filter(pairs, lambda p: p["v"] != ""))
    return df.withColumn("_w", whole).select("path", meta.alias("meta"), F.expr("substring(content, length(_w) + 1)").alias("body"), F.length("_w").alias("body_start"))


def collect_files(spark: SparkSession, root: str, allow: list[str], deny: list[str]) -> DataFrame:
    """Files under root with size and digest, those that a pattern allows and none denies."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    held: Column = F.lit(False)
    for p in allow:
        held = held | F.col("path").rlike(p)
    for p in deny:
        held = held & ~F.col("path").rlike(p)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.when(name.rlike(r"\.(csv|csv\.gz)$"), "table").when(name.rlike(r"\.(md|txt)$"), "text").when(name.rlike(r"\.(pdf|docx)$"), "rendered").otherwise("other")
    return df.where(held).select("path", name.alias("name"), F.regexp_replace(name, r"\..*$", "").alias("doc_id"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("profile"))


def read_sections_xml(spark: SparkSession, path: str) -> DataFrame:
    """Sections of a title: (citation, heading, body) of the elements DIV8 of type SECTION."""
    df = spark.read.format("xml").option("rowTag", "DIV8").schema("_N string, _TYPE string, HEAD string, P array<string>").load(path)
    return df.where("_TYPE = 'SECTION'").select(F.col("_N").alias("citation"), F.trim("HEAD").alias("heading"), F.array_join("P", "\n").alias("body"))


def read_register_json(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Documents of the register's result pages, published at or after a date."""
    kind = "results array<struct<document_number:string,title:string,abstract:string,type:string,publication_date:string,effective_on:string,agencies:array<struct<name:string>>,cfr_references:array<struct<title:int,part:int>>>>"
    df = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")
    df = df.withColumns({c: F.col(c).try_cast("date") for c in ("publication_date", "effective_on")})
    return df if since is None else df.where(F.col("publication_date") >= since)


def write_snapshot(df: DataFrame, path: str, key: str, without: tuple[str, ...] = ()) -> None:
    """JSON lines in order of the key."""
    df.drop(*without).orderBy(key).write.mode("overwrite").json(path)


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path, compression="zstd")


def write_once(df: DataFrame, stored: DataFrame | None, key: str = "name", digest: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(rows to write, conflicts): what is stored with the same digest is skipped, with another one it is a conflict."""
    if stored is None:
        return df, df.limit(0)
    old = stored.select(key, F.col(digest).alias("_old"))
    both = df.join(old, key, "left")
    return both.where("_old is null").drop("_old"), both.where(F.col("_old") != F.col(digest)).drop("_old")
