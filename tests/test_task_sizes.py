"""What a task holds doesn't grow with the input."""

import numpy as np
import pyarrow as pa

from tessera.functions import grammar as G
from tessera.functions import text as T
from tessera.operators import engine, retrieval
from tessera.operators.stages import spread


def test_a_footprint_is_dealt_into_parts_of_so_many_changes(spark):
    ch = spark.createDataFrame([(k, k, 1 if k < 3 else None) for k in range(40)], "change_id long, s1_section_id long, rule_key long")
    ci = spark.createDataFrame([(7, "resolved", 0, 1), (7, "resolved_rule", 0, 1), (8, "resolved_rule", 5, 1), (9, "resolved", 5, None), (9, "resolved", 5, None), (9, "other", 6, 1)], "clause_pk long, status string, section_id long, rule_key long")
    df = engine.in_footprint(ch, ci, rows=2)
    assert {r.change_id: r.cited_clause_count for r in df.collect() if r.in_footprint} == {0: 2, 1: 2, 2: 2, 5: 1}
    assert df.count() == 40 and not df.where("cited_clause_count is null").count()
    assert "hashpartitioning(change_id#" in (plan := df._jdf.queryExecution().executedPlan().toString()) and ", 20)" in plan


def test_signed_sums_in_one_pass(spark):
    h = [64, 128, -64, 65, -1, 0]
    df = spark.createDataFrame([(1, h), (2, None), (3, [])], "k long, h array<long>").coalesce(1)
    got = {r.k: r.v for r in df.select("k", T.signed_sums("h").alias("v")).collect()}
    assert got[1][0] == 2 - 1 - 1 and got[1][1] == 1 and got[1][63] == -1 and len(got[1]) == 64
    assert got[2] == [None] * 64 and got[3] == [0.0] * 64


def test_spread_makes_more_parts_of_more_rows(spark):
    assert spread(spark.range(100).coalesce(1), rows=2).rdd.getNumPartitions() == 50


def test_offsets_of_needles(spark):
    df = spark.createDataFrame([(1, "the 😀 theatre; aathe", "the"), (2, None, "the"), (3, "aaaa", "aa"), (4, "x", ""), (5, "x.x", "."), (6, "x", None)], "k int, t string, n string").coalesce(1)
    got = {r.k: [(s.start, s.stop) for s in r.o] for r in df.select("k", G.offsets("t", "n").alias("o")).collect()}
    assert got == {1: [(0, 3), (6, 9), (17, 20)], 2: [], 3: [(0, 2), (2, 4)], 4: [], 5: [(1, 2)], 6: []}


def test_citations_are_found_by_the_letters_they_cannot_do_without():
    text = "See 170 IAC 4-1-23, IC 8-1-2-4, 47 U. S. C. no, 16 U.S.C. 824, 18 C.F.R. 35.13 and NERC CIP-002"
    assert [c["kind"] for c in G.find_citations(text)] == ["iac", "ic", "usc", "cfr", "standard"]
    assert {k for k, _ in G.FORMS} == set(G.MARKS)


def test_scores_are_made_for_as_many_queries_as_fit(monkeypatch):
    rng = np.random.default_rng(1)
    vec = [list(map(float, v)) for v in rng.integers(-3, 4, (60, 4))]
    rows, queries = pa.table({"key": range(60), "vec": vec}), pa.table({"query": range(0, 60, 3), "wanted": vec[::3]})
    want = retrieval.best_of_block(rows, queries, 5, True)
    seen = []
    monkeypatch.setattr(retrieval, "SCORES", 130)
    real = retrieval.np.round
    monkeypatch.setattr(retrieval.np, "round", lambda x, d: seen.append(x.size) or real(x, d))
    assert retrieval.best_of_block(rows, queries, 5, True).equals(want) and max(seen) <= 130


def test_neighbours_are_dealt_into_parts_of_so_many_lines(spark, monkeypatch):
    from tessera.plans import clauses

    monkeypatch.setattr(clauses, "parts", lambda df, rows: 33)
    df = clauses.typed_neighbours(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"), spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey#" in plan and plan.count(", 33), REPARTITION_BY_NUM") >= 2


def test_lines_are_scanned_once(spark):
    from tessera.sources import markdown

    df = markdown.segments(spark.createDataFrame([("D", "# A\n\n<!-- clause: D:1 -->\nx")], "doc_id string, text string"))
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
