"""Suites of data checks, declared and run together: a table's row checks in one pass, others as joins and aggregates.

Every check gives n_violations; it passes if there is none. Rows for which a
condition is unknown (null) violate it, so a missing value never passes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]
#: Rows of a failed check that are shown.
SAMPLE = 20


@dataclass(frozen=True)
class Check:
    """name; of which table; holds: what must be true of every row, or violations: the rows that shouldn't be, from all tables."""

    name: str
    table: str
    holds: Column | None = None
    violations: Callable[[Tables], DataFrame] | None = None


def rows(name: str, table: str, holds: Column) -> Check:
    return Check(name, table, holds)


def domain(name: str, table: str, column: str, *values) -> Check:
    return rows(name, table, F.col(column).isin(*values))


def matches(name: str, table: str, column: str, form: str) -> Check:
    return rows(name, table, F.col(column).cast("string").rlike(form))


def implies(name: str, table: str, when: Column, then: Column) -> Check:
    """Where one holds the other must."""
    return rows(name, table, ~F.coalesce(when, F.lit(False)) | F.coalesce(then, F.lit(False)))


def ordered(name: str, table: str, *columns: str) -> Check:
    """Times in this order, those that are missing left out."""
    steps = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return rows(name, table, reduce(lambda x, y: x & y, [F.coalesce(F.col(a) <= F.col(b), F.lit(True)) for a, b in steps]))


def unique(name: str, table: str, *columns: str) -> Check:
    """Every row beyond the first of a key is one too many."""
    return Check(name, table, violations=lambda t: t[table].groupBy(*columns).agg((F.count("*") - 1).alias("_more")).where("_more > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("_more"))).alias("_again")))


def foreign(name: str, table: str, column: str, parent: str, key: str) -> Check:
    return Check(name, table, violations=lambda t: t[table].join(t[parent].select(F.col(key).alias(column)), column, "left_anti"))


def has_some(name: str, table: str, key: str, child: str, column: str, where: str = "true") -> Check:
    """Every row has a child that fits."""
    return Check(name, table, violations=lambda t: t[table].join(t[child].where(where).select(F.col(column).alias(key)), key, "left_anti"))


def unchanged(name: str, base: str, now: str, key: list[str], columns: list[str]) -> Check:
    """Rows of base are still there, with the same values."""

    def found(t: Tables) -> DataFrame:
        a = t[base].select(*key, F.struct(*columns).alias("_a"))
        b = t[now].select(*key, F.struct(*columns).alias("_b"))
        return a.join(b, key, "left").where(~F.col("_a").eqNullSafe(F.col("_b")))

    return Check(name, base, violations=found)


def totals(name: str, table: str, key: str, amount: Column, child: str, column: str, part: Column, tolerance: float) -> Check:
    """A row's amount is the sum of its children's parts, within a share of it."""

    def found(t: Tables) -> DataFrame:
        sums = t[child].groupBy(F.col(column).alias(key)).agg(F.sum(part).alias("_sum"))
        return t[table].withColumn("_amount", amount).join(sums, key, "left").where(F.abs(F.col("_amount") - F.coalesce("_sum", F.lit(0.0))) > tolerance * F.abs("_amount"))

    return Check(name, table, violations=found)


def at_most(name: str, sample: str, column: str, population: str, key: str, size: Column) -> Check:
    """A group's sample isn't larger than the group; a group that isn't there has none."""

    def found(t: Tables) -> DataFrame:
        n = t[sample].groupBy(F.col(column).alias(key)).agg(F.count("*").alias("_n"))
        return n.join(t[population].select(key, size.alias("_size")), key, "left").where(F.col("_n") > F.coalesce("_size", F.lit(0)))

    return Check(name, sample, violations=found)


def measured(name: str, table: str, value: Column, low: float | None, high: float | None) -> Check:
    """An aggregate of the table lies between two numbers; none of an empty table does."""

    def found(t: Tables) -> DataFrame:
        x = F.col("_value")
        ok = x.isNotNull() & (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x <= high)
        return t[table].agg(value.cast("double").alias("_value")).where(~ok)

    return Check(name, table, violations=found)


def run_suite(checks: list[Check], tables: Tables) -> DataFrame:
    """(check_name, n_violations, passed) of every check."""
    found: list[DataFrame] = []
    for name in dict.fromkeys(c.table for c in checks if c.holds is not None):
        own = [c for c in checks if c.holds is not None and c.table == name]
        counts = tables[name].agg(*[F.count_if(~F.coalesce(c.holds, F.lit(False))).alias(f"c{i}") for i, c in enumerate(own)])
        pairs = F.array(*[F.struct(F.lit(c.name).alias("check_name"), F.col(f"c{i}").alias("n_violations")) for i, c in enumerate(own)])
        found.append(counts.select(F.explode(pairs).alias("p")).select("p.*"))
    for c in checks:
        if c.violations:
            found.append(c.violations(tables).agg(F.lit(c.name).alias("check_name"), F.count("*").alias("n_violations")))
    return reduce(DataFrame.unionByName, found).withColumn("passed", F.col("n_violations") == 0)


def shown(check: Check, tables: Tables, sample: int = SAMPLE) -> DataFrame:
    """Some rows that a check finds."""
    if check.violations:
        return check.violations(tables).limit(sample)
    return tables[check.table].where(~F.coalesce(check.holds, F.lit(False))).limit(sample)
