"""A system's findings against the expected ones: one to one, greedily and in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

MATCHED = "finding_id long, system_id long"


def first_free(edges: pa.Table) -> pa.Table:
    """Each expected finding in order takes the first system finding that fits and isn't taken."""
    rows = sorted(zip(*(edges[c].to_pylist() for c in ("wanted_at", "finding_id", "found_at", "system_id")), strict=True))
    taken, done, out = set(), set(), []
    for _, finding, _, system in rows:
        if finding not in done and system not in taken:
            done.add(finding)
            taken.add(system)
            out.append((finding, system))
    return pa.table({"finding_id": pa.array([x[0] for x in out], pa.int64()), "system_id": pa.array([x[1] for x in out], pa.int64())})


def edges(expected: DataFrame, system: DataFrame) -> DataFrame:
    """Which findings fit each other: of one document and section, the clause among the acceptable ones or, where that is tolerated, a parent of one.

    Parents are prefixes of clause ids, so that they too meet by equality.
    """
    section = T.section_level(F.col("citation"))
    parts = lambda a: F.split(a, r"\.")
    prefixes = lambda a: F.transform(F.sequence(F.lit(1), F.size(parts(a))), lambda n: F.array_join(F.slice(parts(a), F.lit(1), n), "."))
    fitting = F.when(F.col("parent_tolerance"), F.flatten(F.transform("acceptable_clause_ids", prefixes))).otherwise(F.col("acceptable_clause_ids"))
    e = expected.select("doc_id", "finding_id", F.col("ordinal").alias("wanted_at"), section.alias("section"), F.explode(F.array_distinct(fitting)).alias("clause_id"))
    s = system.select("doc_id", "system_id", F.col("ordinal").alias("found_at"), section.alias("section"), "clause_id")
    return e.join(s, ["doc_id", "section", "clause_id"])


def matches(expected: DataFrame, system: DataFrame) -> DataFrame:
    """(finding_id, system_id). expected: doc_id, finding_id, ordinal, citation, acceptable_clause_ids, parent_tolerance; system: doc_id, system_id, ordinal, citation, clause_id.

    Findings of different documents or sections never compete, so each group is
    settled by itself.
    """
    fits = edges(expected, system).select("doc_id", "section", "wanted_at", "finding_id", "found_at", "system_id")
    return fits.groupBy("doc_id", "section").applyInArrow(first_free, MATCHED)


def scores(expected: DataFrame, system: DataFrame, matched: DataFrame, must_not_flag: DataFrame) -> DataFrame:
    """One row: n_expected, n_system, n_matched, precision, recall, n_wrongly_flagged, false_positive_rate; must_not_flag: doc_id, clause_id."""
    must_not = must_not_flag.distinct()
    n = expected.agg(F.count("*").alias("n_expected")).join(system.agg(F.count("*").alias("n_system"))).join(matched.agg(F.count("*").alias("n_matched"))).join(must_not.agg(F.count("*").alias("n_forbidden")))
    n = n.join(system.join(must_not, ["doc_id", "clause_id"]).agg(F.count("*").alias("n_wrongly_flagged")))  # five tables of one row each
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return n.select("n_expected", "n_system", "n_matched", share("n_matched", "n_system").alias("precision"), share("n_matched", "n_expected").alias("recall"), "n_wrongly_flagged", share("n_wrongly_flagged", "n_forbidden").alias("false_positive_rate"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys each of two extractions has, how many both, and precision, recall and F1 of b against a."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    n = x.join(y, keys, "full_outer").agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"))
    part = lambda over: F.when(F.col(over) > 0, F.col("n_both") / F.col(over)).otherwise(0.0)
    return n.select("n_a", "n_b", "n_both", part("n_b").alias("precision"), part("n_a").alias("recall"), F.when(F.col("n_a") + F.col("n_b") > 0, 2 * F.col("n_both") / (F.col("n_a") + F.col("n_b"))).otherwise(0.0).alias("f1"))


def scorecard(expected: DataFrame, rollup: DataFrame) -> DataFrame:
    """One row: documents with an expected status, how many have it, those flagged in vain and those missed. A document that the run doesn't know counts as cleared."""
    both = expected.select("doc_id", F.col("status").alias("want")).join(rollup.select("doc_id", F.col("status").alias("got")), "doc_id", "left").withColumn("got", F.coalesce("got", F.lit("cleared")))
    flagged = lambda c: F.col(c) == "flagged"
    return both.agg(F.count("*").alias("n_docs"), F.count_if(F.col("want") == F.col("got")).alias("n_agree"), F.count_if(flagged("got") & ~flagged("want")).alias("n_in_vain"), F.count_if(~flagged("got") & flagged("want")).alias("n_missed")).withColumn("share", F.when(F.col("n_docs") > 0, F.round(F.col("n_agree") / F.col("n_docs"), 6)).otherwise(0.0))
