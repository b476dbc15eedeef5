import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import tables, values
from tessera.operators import calendars, scoring, whatif
from tessera.plans import engine as plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("text", "old", "new", "near", "want"),
    [
        ("within ten (10) days", 10, 15, None, ("within fifteen (15) days", "ten (10)", "fifteen (15)")),
        ("Ten  ( 10 ) or 10", 10, 21, None, ("Twenty-one  ( 21 ) or 10", "Ten  ( 10 )", "Twenty-one  ( 21 )")),
        ("10 days, then 10 more", 10, 15, 14, ("10 days, then 15 more", "10", "15")),
        ("10 days, then 10 more", 10, 15, None, ("15 days, then 10 more", "10", "15")),
        ("10.5 and 1,000 and 4-1-10 and §10 and 10-day", 10, 15, None, None),
        ("THIRTY days", 30, 45, None, ("FORTY-FIVE days", "THIRTY", "FORTY-FIVE")),
        ("one hundred five copies", 105, 158, None, ("one hundred fifty-eight copies", "one hundred five", "one hundred fifty-eight")),
        ("1000 copies", 1000, 1500, 3, ("1500 copies", "1000", "1500")),
        ("", 1, 2, None, None),
    ],
)
def test_values_keep_their_form(text, old, new, near, want):
    assert values.replace_one(text, old, new, near) == want


def test_replaced_with_nulls(spark):
    df = spark.createDataFrame([("in 5 days", 5, 8, None), (None, 5, 8, 1), ("in 5 days", None, 8, 1)], "t string, a int, b int, p int")
    assert [r.h.text for r in df.select(values.replaced("t", "a", "b", "p").alias("h")).collect()] == ["in 8 days", None, None]
    assert [r[0] for r in spark.createDataFrame([(1,), (3,), (5,), (40,)], "n int").select(values.changed_value(F.col("n"))).collect()] == [2, 4, 8, 60]


def test_an_incremental_run_equals_a_whole_one(spark):
    def t(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")

    ch, base, edits, more = plans.scenario(t)
    extra = edits.limit(1).withColumns({"change_id": F.lit(-1).cast("long"), "change_class": F.lit("substantive")})  # a change that the base run doesn't have
    edits = edits.unionByName(extra)
    whole = whatif.decided(ch.join(edits.select("change_id"), "change_id", "left_anti").unionByName(edits), *more)
    after = whatif.what_if(base, edits, *more)
    key = ["change_id", "clause_id", "rule", "finding_type", "from_text", "to_text", "verdict"]
    a, b = (sorted(map(str, df.select(key).collect())) for df in (after, whole))
    assert a == b and len(a) > 1000
    told = whatif.differences(base, after).collect()
    ids = {r.change_id for r in edits.select("change_id").collect()}
    assert told and {r.change_id for r in told} <= ids
    assert whatif.differences(base, base).count() == 0


def greedy(expected, system):
    used, out = set(), []
    for doc, finding, _, cit, ok, tolerant in sorted(expected, key=lambda e: (e[0], e[2], e[1])):
        for d, s, _, c, clause in sorted(system, key=lambda x: (x[0], x[2], x[1])):
            fits = clause in ok or tolerant and any(a.startswith(clause + ".") for a in ok)
            if d == doc and s not in used and c.split("(")[0] == cit.split("(")[0] and fits:
                used.add(s)
                out.append((finding, s))
                break
    return sorted(out)


def test_matches_are_greedy_in_order(spark):
    rng = random.Random(4)
    clause = lambda: rng.choice(["1", "1.1", "1.1.2", "1.10", "2", "2.1"])
    expected = [(rng.randrange(4), i, rng.randrange(30), f"1 IAC {rng.randrange(2)}(a)", [clause() for _ in range(rng.choice([1, 2]))], rng.random() < 0.5) for i in range(120)]
    system = [(rng.randrange(4), i, rng.randrange(30), f"1 IAC {rng.randrange(2)}", clause()) for i in range(120)]
    e = spark.createDataFrame(expected, "doc_id long, finding_id long, ordinal int, citation string, acceptable_clause_ids array<string>, parent_tolerance boolean")
    s = spark.createDataFrame(system, "doc_id long, system_id long, ordinal int, citation string, clause_id string")
    m = scoring.matches(e, s)
    want = greedy(expected, system)
    assert sorted(map(tuple, m.collect())) == want and len(want) > 30
    none = spark.createDataFrame([(0, "2"), (9, "2")], "doc_id long, clause_id string")
    r = scoring.scores(e, s, m, none).first()
    wrong = sum(1 for x in system if x[0] == 0 and x[4] == "2")
    assert (r.n_expected, r.n_system, r.n_matched, r.n_wrongly_flagged) == (120, 120, len(want), wrong) and r.recall == pytest.approx(len(want) / 120) and r.false_positive_rate == pytest.approx(wrong / 2)
    empty = scoring.scores(e.limit(0), s.limit(0), m.limit(0), none.limit(0)).first()
    assert (empty.precision, empty.recall, empty.false_positive_rate) == (0.0, 0.0, 0.0)


def test_expected_findings_of_the_tables_are_matched_greedily(spark):
    def t(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")

    e, s = (df.collect() for df in plans_findings(t))
    got = sorted(map(tuple, scoring.matches(*plans_findings(t)).collect()))
    by_doc = {}
    for x in s:
        by_doc.setdefault(x.doc_id, []).append((x.doc_id, x.system_id, x.ordinal, x.citation, x.clause_id))
    want = []
    for doc in {x.doc_id for x in e}:
        want += greedy([(x.doc_id, x.finding_id, x.ordinal, x.citation, x.acceptable_clause_ids, x.parent_tolerance) for x in e if x.doc_id == doc], by_doc.get(doc, []))
    assert got == sorted(want) and len(want) > 50


def plans_findings(t):
    from tessera.plans.grammars import findings

    return findings(t)


def test_calendar(spark):
    more = spark.createDataFrame([("2024-03-05",)], "day string").withColumn("day", F.to_date("day"))
    days = calendars.calendar(spark, "2024-01-01", "2024-12-31", ["09:00:00", "15:00:00"], ["12:00:00"], more)
    off = {str(r.day) for r in days.where("not is_business_day and weekday(day) < 5").collect()}
    assert off == {"2024-01-01", "2024-01-15", "2024-02-19", "2024-03-05", "2024-05-27", "2024-07-04", "2024-09-02", "2024-11-11", "2024-11-28", "2024-11-29", "2024-12-25", "2024-12-26"}
    at = ["2024-03-04 08:59:59", "2024-03-04 09:00:00", "2024-03-04 15:00:00", "2024-03-05 11:00:00", "2024-03-05 12:00:00", "2024-03-08 16:00:00", "2024-12-31 16:00:00", None]
    df = spark.createDataFrame([(x,) for x in at], "t string").withColumn("t", F.to_timestamp("t"))
    got = {str(r.t): str(r.next_slot) for r in calendars.next_slot(df, "t", days).collect()}
    want = ["2024-03-04 09:00:00", "2024-03-04 15:00:00", "2024-03-05 12:00:00", "2024-03-05 12:00:00", "2024-03-06 09:00:00", "2024-03-09 12:00:00", "2025-01-01 12:00:00", "None"]
    assert got == {str(a): w for a, w in zip(at, want, strict=True)}
    assert datetime.date(2024, 11, 28).weekday() == 3


def test_word_windows(spark):
    tables.register(spark)
    rng = random.Random(5)
    rows = [(c, i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 3, 10])))) for c in range(30) for i in range(rng.randint(1, 9))] + [(77, 0, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(4)
    got = {(r.conv_id, r.chunk): (r.first_turn, r.words.split()) for r in spark.sql("select * from word_windows(table({t}), size => 8, overlap => 3)", t=df).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        words = [(i, w) for k, i, x in sorted(rows, key=lambda r: (r[0], r[1])) if k == c for w in (x or "").split()]
        at = 0
        while words and (at == 0 or at + 3 < len(words)):
            want[c, at // 5] = (words[at][0], [w for _, w in words[at : at + 8]])
            at += 5
    assert got == want
    with pytest.raises(Exception, match="overlap"):
        spark.sql("select * from word_windows(table({t}), size => 3, overlap => 3)", t=df).collect()
    with pytest.raises(Exception, match="lacks"):
        spark.sql("select * from word_windows(table({t}), size => 3, overlap => 1)", t=df.drop("turn")).collect()


def test_number_words_both_ways():
    assert all(values.number_in(values.words_of(n)) == n for n in range(1, 1000))
    assert values.words_of(0) is None and values.words_of(1000) is None and values.words_of(158) == "one hundred fifty-eight"
    for text, n in [("Two Thousand Five Hundred", 2500), ("one hundred and five", 105), ("thirty five", 35), ("zero", 0), ("hundred", None), ("ten days", None), ("", None), (None, None)]:
        assert values.number_in(text) == n


def test_a_what_if_run_broadcasts_no_more_than_the_numbers_of_few_edits(spark, monkeypatch):
    def t(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")

    plan = lambda: plans.edited_run(t, spark)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan().splitlines() if "BroadcastHashJoin" in x]
    assert len(joins) == 2 and all("change_id" in x and "LeftAnti" in x for x in joins)  # where candidates are open, and where not
    monkeypatch.setattr(whatif, "FEW", 0)
    assert "Broadcast" not in plan()
