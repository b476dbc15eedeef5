"""Exact similarity joins over sets of shingles, and cosine joins within blocks.

Two sets of which one has at least the share ``least`` of their union in common
share one of their first elements in any order that is the same for all sets: of
n elements one of the first n - ceil(least n) + 1. So sets meet by these alone.
Frequent elements, that a third of all rows may have, come last in the order and
bring nobody together.
Equal sets are one class and cost a row each.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators.stages import kept

LEAST = Fraction(4, 5)
#: Sets that an element may bring together, and how many frequent elements (16 MB) and keys are known in every task at most.
CROWD, FREQUENT, KEYS = 32, 2_000_000, 500_000


def shingle_sets(df: DataFrame, block: str, key: str, words) -> DataFrame:
    """(block, key, g, n, same): the hashed five-word shingles of a row's words, how many, and a hash of all of them."""
    g = T.shingles(words, hashed=True)
    sets = df.select(F.col(block).alias("block"), F.col(key).alias("key"), g.alias("g"))
    return sets.select("block", "key", "g", F.size("g").alias("n"), F.xxhash64(F.array_sort("g")).alias("same"))


def classes(sets: DataFrame) -> DataFrame:
    """(block, same, n, first, second): the two smallest keys of each class of equal sets."""
    least = sets.groupBy("block", "same", "n").agg(F.min("key").alias("first"))
    rest = sets.join(least, ["block", "same", "n"]).where(F.col("key") > F.col("first")).groupBy("block", "same", "n").agg(F.min("key").alias("second"))
    return least.join(rest, ["block", "same", "n"], "left")


def prefixes(sets: DataFrame, counts: DataFrame, least: Fraction) -> DataFrame:
    """(block, s, key, n): each set's rarest elements, of those that others have too."""
    common = sets.select("block", "key", "n", F.explode("g").alias("s")).join(counts, ["block", "s"])
    ranked = common.groupBy("block", "key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("e"))
    # elements that no other set has come first in order and are left out
    own = F.col("n") - F.size("e")
    length = F.expr(f"n - (n * {least.numerator} + {least.denominator - 1}) div {least.denominator} + 1").cast("int") - own
    return ranked.where(length > 0).select("block", "key", "n", F.explode(F.slice("e", F.lit(1), length)).alias("e")).select("block", "e.s", "key", "n")


def by_rarest(left: DataFrame, right: DataFrame | None, least: Fraction) -> DataFrame:
    """(block, a, b): the sets that share one of their rarest elements, by exact counts of all; without right, pairs a < b of left."""
    every = left.select("block", "g") if right is None else left.select("block", "g").unionByName(right.select("block", "g"))
    counts = kept(every.select("block", F.explode("g").alias("s")).groupBy("block", "s").agg(F.count("*").alias("df")).where("df > 1"))
    mine = prefixes(left, counts, least)
    return meeting(mine, mine if right is None else prefixes(right, counts, least), least, right is None)


def meeting(mine: DataFrame, theirs: DataFrame, least: Fraction, itself: bool) -> DataFrame:
    """(block, a, b) of rows (block, s, key, n) that share s and whose sizes allow for the likeness."""
    a, b = mine.withColumnsRenamed({"key": "a", "n": "x"}), theirs.withColumnsRenamed({"key": "b", "n": "y"})
    p, q = least.numerator, least.denominator
    meet = a.join(b, ["block", "s"]).where(f"{q} * x >= {p} * y and {q} * y >= {p} * x")
    return (meet.where("a < b") if itself else meet).select("block", "a", "b").distinct()


def first_elements(sets: DataFrame, least: Fraction) -> DataFrame:
    """(block, key, n, p, look): each set's first p elements in order of their hashes, and a tenth of the set more to take the place of frequent ones."""
    p = F.expr(f"n - (n * {least.numerator} + {least.denominator - 1}) div {least.denominator} + 1").cast("int")
    df = sets.where("n > 0").select("block", "key", "n", p.alias("p"), F.array_sort("g").alias("g"))
    return df.select("block", "key", "n", "p", F.slice("g", F.lit(1), F.col("p") + F.expr("(n + 9) div 10").cast("int")).alias("look"))


def frequent(looks: list[DataFrame]) -> np.ndarray:
    """The elements that more than CROWD sets of a block have among their first, or more than one in FREQUENT of all rows: so many at most."""
    every = looks[0].select("block", "look")
    for more in looks[1:]:
        every = every.unionByName(more.select("block", "look"))
    most = max(CROWD, math.ceil((every.agg(F.sum(F.size("look"))).first()[0] or 0) / FREQUENT))
    df = every.select("block", F.explode("look").alias("s")).groupBy("block", "s").agg(F.count("*").alias("df"))
    return np.sort(df.where(F.col("df") > most).select("s").distinct().toArrow()["s"].to_numpy())


def without(elements: Column, out: Broadcast) -> Column:
    """Arrays of longs without those of a sorted list."""

    @F.arrow_udf("array<long>")
    def rest(x: pa.Array) -> pa.Array:
        values, sizes, known = x.flatten().to_numpy(zero_copy_only=False), x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out.value
        stays = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] != values
        left = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(left.astype("i4")), pa.array(values[stays]))

    return rest(elements)


def bounded(keys: DataFrame) -> DataFrame:
    """Written keys, to be broadcast if they are few enough for every task."""
    return F.broadcast(keys) if keys.count() <= KEYS else keys


def similar(left: DataFrame, right: DataFrame | None = None, least: Fraction = LEAST) -> DataFrame:
    """(block, a, b, score): keys of left and right sets (each key once) of one block with a Jaccard likeness of ``least`` or more; without right, pairs a < b of left.

    The prefix may follow any order that all sets share, so it is taken by hash
    with frequent elements last: only a third of the elements are counted and a
    fifth dealt. What two prefixes have in common bounds the likeness; only sets
    that it allows for are fetched whole. Sets that have frequent elements in
    their prefix meet each other by exact counts of all their elements.
    """
    spark, p, q = left.sparkSession, least.numerator, least.denominator
    looks = [kept(first_elements(df, least)) for df in (left, *([] if right is None else [right]))]
    many = frequent(looks)
    own = without(F.col("look"), spark.sparkContext.broadcast(many)) if len(many) else F.col("look")
    sides = [df.select("block", "key", "n", "p", own.alias("own")).select("block", "key", "n", F.slice("own", F.lit(1), F.col("p")).alias("e"), (F.size("own") < F.col("p")).alias("crowded")) for df in looks]
    sides = [kept(df) for df in sides] if len(many) else sides
    rows = [df.select("block", F.explode("e").alias("s"), "key", "n") for df in sides]
    pairs = meeting(rows[0], rows[-1], least, right is None)
    side = lambda df, key, n, e: df.select("block", F.col("key").alias(key), F.col("n").alias(n), F.col("e").alias(e))
    both = pairs.join(side(sides[0], "a", "x", "e_a"), ["block", "a"]).join(side(sides[-1], "b", "y", "e_b"), ["block", "b"])
    # up to the smaller one's last element both prefixes are whole
    both = both.withColumn("last", F.least(F.element_at("e_a", -1), F.element_at("e_b", -1)))
    rest = lambda n, e: F.col(n) - F.size(F.filter(e, lambda v: v <= F.col("last")))
    bound = F.size(F.array_intersect("e_a", "e_b")) + F.least(rest("x", "e_a"), rest("y", "e_b"))
    pairs = both.where((p + q) * bound >= p * (F.col("x") + F.col("y"))).select("block", "a", "b")
    if len(many):
        crowded = [kept(df.where("crowded").select("block", "key")) for df in sides]
        if not any(df.isEmpty() for df in crowded):
            some = [df.join(c, ["block", "key"], "left_semi") for df, c in zip((left, right), crowded, strict=False)]
            pairs = pairs.unionByName(by_rarest(some[0], None if right is None else some[1], least)).distinct()
    pairs = kept(pairs)

    def fetched(df: DataFrame, *names: str) -> DataFrame:
        keys = kept(pairs.select("block", F.explode(F.array(*names)).alias("key")).distinct())
        return kept(df.select("block", "key", "g").join(bounded(keys), ["block", "key"], "left_semi"))

    whole = [fetched(left, "a", "b")] if right is None else [fetched(left, "a"), fetched(right, "b")]
    g = lambda df, name: df.select("block", F.col("key").alias(name), F.col("g").alias(f"g_{name}"))
    both = pairs.join(g(whole[0], "a"), ["block", "a"]).join(g(whole[-1], "b"), ["block", "b"])
    shared = F.size(F.array_intersect("g_a", "g_b"))
    scored = both.select("block", "a", "b", shared.alias("k"), (F.size("g_a") + F.size("g_b") - shared).alias("u"))
    return scored.where(f"{q} * k >= {p} * u").select("block", "a", "b", (F.col("k") / F.col("u")).alias("score"))


def without_copies(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """The first set of each class: the others, which are fewer, are left out, so that elements needn't be dealt for it."""
    copies = kept(sets.select("block", "key", "same", "n").join(firsts.select("block", "same", "n", "first"), ["block", "same", "n"]).where("key <> first").select("block", "key"))
    return sets.join(bounded(copies), ["block", "key"], "left_anti")


def best_of_others(new: DataFrame, old: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """(block, key, other, score): for each new set the old one that is most alike, by ``least`` or more, and has another key; of equals the smallest key."""
    n = kept(new)
    new_classes = kept(classes(n))

    if old is new:  # each pair is found once and read both ways, and a class is like itself
        old_classes = new_classes
        pairs = kept(similar(without_copies(n, new_classes), None, least))
        itself = new_classes.select("block", F.col("first").alias("a"), F.col("first").alias("b"), F.lit(1.0).alias("score"))
        found = pairs.unionByName(pairs.select("block", F.col("b").alias("a"), F.col("a").alias("b"), "score")).unionByName(itself)
    else:
        o = kept(old)
        old_classes = kept(classes(o))
        found = similar(without_copies(n, new_classes), without_copies(o, old_classes), least)
    by_class = found.join(new_classes.select("block", F.col("first").alias("a"), "same", "n"), ["block", "a"])
    options = by_class.join(old_classes.select("block", F.col("first").alias("b"), "second"), ["block", "b"]).select("block", "same", "n", "score", F.col("b").alias("first"), "second")
    each = n.select("block", "key", "same", "n").join(options, ["block", "same", "n"])
    other = F.when(F.col("first") != F.col("key"), F.col("first")).otherwise(F.col("second"))
    best = F.min_by(F.struct("other", "score"), F.struct(-F.col("score"), F.col("other")))
    return each.withColumn("other", other).where("other is not null").groupBy("block", "key").agg(best.alias("m")).select("block", "key", "m.other", "m.score")


def restates(clauses: DataFrame, params: DataFrame, links: DataFrame, least: float = 0.6, most: int = 200) -> DataFrame:
    """(from_id, to_id, score, signature): clauses that state one parameter and are alike, in both directions, by the signature that sorts first.

    clauses: clause_id, doc_id, sections (array), vec (of length one); params:
    clause_id, signature; links: from_id, to_id. Two clauses of one signature meet
    if they share a section, or if one cites none and they are of one document or
    linked. A signature of more than ``most`` clauses says too little and is left
    out, so no block makes more than ``most`` pairs a row.
    """
    signed = params.select("clause_id", "signature").distinct()
    small = signed.groupBy("signature").agg(F.count("*").alias("k")).where(F.col("k") <= most).select("signature")
    s = kept(signed.join(small, "signature").join(clauses.select("clause_id", "doc_id", "sections"), "clause_id"))
    bare = F.size("sections") == 0
    side = lambda df, name, *more: df.select("signature", F.col("clause_id").alias(name), *more)
    cited = s.select("signature", "clause_id", F.explode(F.array_distinct("sections")).alias("section"))
    shared = side(cited, "a", "section").join(side(cited, "b", "section"), ["signature", "section"])
    same = side(s.where(bare), "a", "doc_id").join(side(s, "b", "doc_id"), ["signature", "doc_id"])
    linked = side(s.where(bare), "a").join(links.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(links.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))), "a").join(side(s, "b"), ["signature", "b"])
    met = [df.where("a <> b").select("signature", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for df in (shared, same, linked)]
    pairs = met[0].unionByName(met[1]).unionByName(met[2]).groupBy("a", "b").agg(F.min("signature").alias("signature"))
    vec = lambda name: clauses.select(F.col("clause_id").alias(name), F.col("vec").alias(f"v_{name}"))
    scored = pairs.join(vec("a"), "a").join(vec("b"), "b").withColumn("score", T.cosine(F.col("v_a"), F.col("v_b"))).where(F.col("score") >= least)
    ends = F.explode(F.array(F.struct(F.col("a").alias("from_id"), F.col("b").alias("to_id")), F.struct(F.col("b").alias("from_id"), F.col("a").alias("to_id"))))
    return scored.select(ends.alias("e"), "score", "signature").select("e.from_id", "e.to_id", "score", "signature")
