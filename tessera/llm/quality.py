"""Quality rules from DataFrame functions alone: base rules and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed token unigrams and bigrams: one
counted over trusted documents (``labels.quality`` = 1), one over all
documents. A document's score is the mean of log p(trusted) - log p(raw) over
its n-grams; documents below ``THRESHOLD`` go, whatever else is in the table.

The raw side counts every document. The trusted side is fitted on at most
``TRUSTED`` labelled documents, those with the smallest hashes, whose ids are
broadcast, so that counting and scoring shuffle no text. Counts are summed by
bucket before the shuffle: ``BUCKETS`` rows reach the driver however large the
corpus is, and go back into the plan as one constant array.

Cases: null and empty texts have no words and fail the base rules; a text
without n-grams scores 0; without trusted documents all scores are 0; repeated
rows are counted and returned each; an empty table gives an empty result; only
``doc_id`` and ``text`` are read, so that other columns can have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS

BUCKETS, SMOOTHING, THRESHOLD, TRUSTED = 1 << 14, 1.0, -0.25, 50_000
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
SYMBOLS, ANY_SYMBOL = "#*$%&|<>", "[#*$%&|<>]"
#: Space and the five ASCII controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: Runs of letters and digits, or of anything else that isn't white space.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"


def tail(a: Column, skip: int, n: Column) -> Column:
    """n elements of a after the first skip."""
    return F.slice(a, F.lit(skip + 1), F.greatest(n, F.lit(0)))


def chained(a: Column, a_skip: int, b: Column, b_skip: int, n: Column) -> Column:
    """n hashes of a[i + a_skip] with b[i + b_skip]."""
    return F.zip_with(tail(a, a_skip, n), tail(b, b_skip, n), lambda x, y: F.xxhash64(x, y))


def base_features(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, text, carried columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # one piece more than there are separators; words are the pieces that aren't empty
    rows = docs.select("doc_id", text.alias("text"), *carried).withColumn("_pieces", F.split("text", SPACE))
    rows = rows.withColumn("_h", F.transform(F.filter("_pieces", lambda w: w != ""), lambda w: F.xxhash64(w)))
    rows = rows.withColumn("n_words", F.size("_h").cast("long"))
    rows = rows.withColumn("_lines", F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(SPACE_CHARS)) != ""))
    # hashes of five-word windows: words 0-1, then 0-3, then 0-4
    n = F.col("n_words").cast("int")
    rows = rows.withColumn("_two", chained(F.col("_h"), 0, F.col("_h"), 1, n - 1))
    rows = rows.withColumn("_four", chained(F.col("_two"), 0, F.col("_two"), 2, n - 3))
    rows = rows.withColumn("_five", chained(F.col("_four"), 0, F.col("_h"), 4, n - (WINDOW - 1)))
    rows = rows.withColumn("_again", F.size("_five") > F.size(F.array_distinct("_five")))
    # only where a window is repeated: sort (hash, place), keep places whose hash stands beside them, and count what they cover
    placed = F.when(F.col("_again"), F.array_sort(F.transform("_five", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_placed", placed)
    beside = lambda x, i: (x["h"] == F.get("_placed", i - 1)["h"]) | (x["h"] == F.get("_placed", i + 1)["h"])
    rows = rows.withColumn("_at", F.sort_array(F.transform(F.filter("_placed", lambda x, i: F.coalesce(beside(x, i), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return rows.select(
        "doc_id",
        "text",
        *carried,
        "n_words",
        (F.length("text") - F.size("_pieces") + 1).cast("long").alias("word_chars"),
        F.when(F.col("text").rlike(ANY_SYMBOL), F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def with_grams(rows: DataFrame) -> DataFrame:
    """Adds grams: the bucket of every token and of every pair of neighbours."""
    rows = rows.withColumn("_t", F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))
    bucket = lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    return rows.withColumn("grams", F.transform(F.concat("_t", chained(F.col("_t"), 0, F.col("_t"), 1, F.size("_t") - 1)), bucket)).drop("_t")


def gram_counts(docs: DataFrame, trusted: DataFrame) -> dict[int, tuple[int, int]]:
    """Occurrences in each bucket over the trusted documents, and over all: BUCKETS rows at most.

    trusted: distinct doc_ids, at most TRUSTED of them, which bounds the broadcast.
    """
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("trusted"))), "doc_id", "left")
    # explode_outer: Spark would put a filter on the array's size under an explode(), and compute all n-grams twice
    grams = with_grams(marked.select("text", "trusted")).select("trusted", F.explode_outer("grams").alias("g"))
    found = grams.groupBy("g").agg(F.count("trusted").alias("t"), F.count("*").alias("n"))
    return {r["g"]: (r["t"], r["n"]) for r in found.collect() if r["g"] is not None}


def log_ratios(counts: dict[int, tuple[int, int]]) -> list[float]:
    """log p(trusted) - log p(raw) of each bucket, with additive smoothing."""
    n_trusted, n_raw = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not n_trusted:
        return [0.0] * BUCKETS
    flat = SMOOTHING * BUCKETS
    return [math.log((counts.get(b, (0, 0))[0] + SMOOTHING) / (n_trusted + flat)) - math.log((counts.get(b, (0, 0))[1] + SMOOTHING) / (n_raw + flat)) for b in range(BUCKETS)]


def fit(docs: DataFrame, labels: DataFrame, most: int = TRUSTED) -> list[float]:
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return log_ratios(gram_counts(docs, good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, base features, llr and kept of every document."""
    ratios = F.split(F.lit(",".join(repr(round(x, 9)) for x in fit(docs, labels))), ",").cast("array<double>")
    rows = with_grams(base_features(docs, *carried))
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(ratios, g))
    rows = rows.withColumn("llr", F.round(F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0), 9))
    return rows.select("doc_id", *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that judge() keeps, with all of their columns."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # a filter isn't moved below a row number; below the features it would hold each of their expressions many times over
    judged = judge(whole, labels, threshold, ("_row",)).select("_row", "kept", F.monotonically_increasing_id().alias("_n"))
    return judged.where("kept and _n >= 0").select("_row.*")
