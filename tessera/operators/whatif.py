"""What an edit of the law would change: only what the edited changes reach is decided anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import engine
from tessera.operators.stages import kept

#: Up to so many edits' numbers are sent to where the base's rows lie, which then aren't moved.
FEW = 1_000_000


def text_edits(changes: DataFrame) -> DataFrame:
    """Changes whose first value is another one now: the new value half as much again, put into the new text where the old text has its own, in the form that stands there."""
    v = F.get("value_changes", 0)
    new = values.changed_value(v["old_value_num"].cast("long"))
    near = F.nullif(F.instr("s1_bare", v["old_value_text"]), F.lit(0)) - 1
    hit = values.replaced(F.col("s1_bare"), v["old_value_num"].cast("long"), new, near)
    told = F.concat(new.cast("string"), F.lit(" "), v["unit"])
    return changes.withColumn("hit", hit).withColumn("value_changes", F.when(F.col("hit.text").isNotNull(), F.array(v.withField("new_value_text", told))).otherwise(F.array().cast(changes.schema["value_changes"].dataType))).withColumn("s2_bare", F.coalesce("hit.text", "s1_bare")).withColumn("change_class", F.lit("substantive")).drop("hit")


def repeals(changes: DataFrame) -> DataFrame:
    return changes.withColumn("change_class", F.lit("repealed"))


def decided(changes: DataFrame, clauses: DataFrame, citations: DataFrame, links: DataFrame, params: DataFrame) -> DataFrame:
    """Candidates of these changes with what the rules say of them."""
    found = engine.candidates(changes, clauses, citations, links, params).withColumn("skip_reason", F.lit(None).cast("string"))
    return engine.decide_by_rules(found, changes, clauses, params)


def what_if(base: DataFrame, edits: DataFrame, clauses: DataFrame, citations: DataFrame, links: DataFrame, params: DataFrame) -> DataFrame:
    """A run's decisions (base) after edits: changes that replace those of their change_id, or are new.

    A candidate belongs to one change, so those of all other changes stand; the
    edits alone go through the paths and rules. How many there are is counted, as
    their files tell too little of it.
    """
    edits = kept(edits)
    ids = edits.select("change_id").distinct()
    rest = base.join(F.broadcast(ids) if edits.count() <= FEW else engine.merged(ids), "change_id", "left_anti")
    return rest.unionByName(decided(edits, clauses, citations, links, params))


def differences(base: DataFrame, after: DataFrame) -> DataFrame:
    """(change_id, clause_id, before, after): what a scenario adds, takes away or decides otherwise."""
    row = lambda df, name: df.select("change_id", "clause_id", F.struct("rule", "finding_type", "from_text", "to_text").alias(name))
    both = row(base, "before").join(row(after, "after"), ["change_id", "clause_id"], "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
