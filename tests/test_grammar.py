import pytest
from pyspark.sql import functions as F

from tessera.functions import grammar as G
from tessera.functions import text as T


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("170 IAC 4-1-16", ["170 IAC 4-1-16"]),
        ("170 IAC 4-1-16(b)(2)(i)", ["170 IAC 4-1-16"]),
        ("327 IAC 2-6.1-7 and 170 IAC 4-1-16.5", ["327 IAC 2-6.1-7", "170 IAC 4-1-16.5"]),
        ("170 IAC 4-1", ["170 IAC 4-1"]),
        ("[170 IAC 4-1-16 through 170 IAC 4-1-18]", ["170 IAC 4-1-16", "170 IAC 4-1-17", "170 IAC 4-1-18"]),
        ("170 IAC 4-1-16 to 4-1-18", ["170 IAC 4-1-16", "170 IAC 4-1-17", "170 IAC 4-1-18"]),
        ("170 IAC 4-1-16..17", ["170 IAC 4-1-16", "170 IAC 4-1-17"]),
        ("18 CFR 35.1 through 35.3", ["18 CFR 35.1", "18 CFR 35.2", "18 CFR 35.3"]),
        ("18 CFR Part 35 and IC 8-1-2-4", ["18 CFR 35", "IC 8-1-2-4"]),
        ("16 U.S.C. § 824, NFPA 70, IEC 61850-3, ISO 9001", ["16 USC 824", "NFPA 70", "IEC 61850-3", "ISO 9001"]),
        ("nothing here", []),
    ],
)
def test_citations(text, want):
    assert [c["citation"] for c in G.find_citations(text)] == want


def test_subsections_and_long_ranges():
    (found,) = G.find_citations("see 170 IAC 4-1-16(b)(2) now")
    assert found["subsection"] == "(b)(2)" and found["rule_key"] == "170 IAC 4-1"
    assert len(G.find_citations("18 CFR 1.1 through 1.400")) == 400
    assert [c["citation"] for c in G.find_citations("18 CFR 1.1 through 1.90000")] == ["18 CFR 1.1", "18 CFR 1.90000"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("within 10 business days", [("period", 10.0, "day", "business")]),
        ("fourteen (14) calendar days", [("period", 14.0, "day", "calendar")]),
        ("pay $45 or 10 percent", [("amount", 45.0, "dollar", None), ("percentage", 10.0, "percent", None)]),
        ("five thousand gallons", [("threshold", 5000.0, "gallon", None)]),
        ("at least twenty-four hours", [("period", 24.0, "hour", None)]),
        ("call 317-555-0199, (317) 555-0199 or 1-800-555-0199", []),
        ("OBL-123, Form FM-12, Sheet No. 10, version 2.3", []),
        ("release 2.3.1 of it", []),
        ("under 170 IAC 4-1-16", []),
    ],
)
def test_parameters(text, want):
    assert [(p["kind"], p["value_num"], p["unit"], p["day_type"]) for p in G.find_parameters(text)] == want


def test_shingles_bind_their_words_once(spark):
    texts = ["", "one", "a b c d e", "a b c d e f a b c d e f", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: (r.s, r.h) for r in df.select("id", T.shingles(F.split("t", " ")).alias("s"), F.size(T.shingles(F.split("t", " "), hashed=True)).alias("h")).collect()}
    for i, t in enumerate(texts[:4]):
        w = t.split(" ")
        want = list(dict.fromkeys(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
        assert got[i] == (want, len(want))
    plan = df.select(T.shingles(F.split("t", " ")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_near_pairs_beside_brute_force(spark, tmp_path):
    import random

    from tessera.queries import QUERIES

    rng = random.Random(2)
    rows = []
    for i in range(120):
        if i % 4 and i > 3:
            words = rows[rng.randrange(len(rows))][2].split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice("xyz")
        else:
            words = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(3, 60))]
        rows.append((i, f"s{i % 2}", " ".join(words)))
    spark.createDataFrame([(*r, "en") for r in [*rows, (900, "s0", None)]], "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_a, r.doc_b): r.score for r in QUERIES["E13_near_pairs"](spark, str(tmp_path)).collect()}
    cut = lambda t: {" ".join(t.lower().split(" ")[k : k + 5]) for k in range(max(1, len(t.split(" ")) - 4))}
    first, want = {}, {}
    for d, s, t in rows:
        g = frozenset(cut(t))
        if (s, g) in first:
            want[first[s, g], d] = 1.0
            continue
        for (s2, g2), e in first.items():
            if s2 == s and len(g & g2) / len(g | g2) >= 0.8:
                want[e, d] = round(len(g & g2) / len(g | g2), 6)
        first[s, g] = d
    assert got == want and len(want) > 20


def test_diffs_beside_difflib(spark, tmp_path):
    """The two queries without SQL, on a small table: neighbours by source, and segments that give both texts back."""
    import difflib
    import hashlib

    from tessera.queries import QUERIES

    base = "\n".join(f"line {i} of the same text" for i in range(12))
    rows = [(1, "s0", base), (2, "s1", "alone"), (3, "s0", base.replace("line 5", "row 5")), (4, "s0", "else"), (5, "s1", None)]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {d: t or "" for d, _, t in rows}
    got = {(r.doc_id, r.before): r.digest for r in QUERIES["I6_line_diff"](spark, str(tmp_path)).collect()}
    assert set(got) == {(3, 1), (4, 3), (5, 2)}
    for (d, e), digest in got.items():
        diff = "\n".join(difflib.unified_diff(texts[e].splitlines(), texts[d].splitlines(), lineterm="", n=1))
        assert digest == hashlib.md5(diff.encode()).hexdigest()
    found = sorted(QUERIES["I2_word_diff"](spark, str(tmp_path)).collect(), key=lambda r: r["at"])
    assert {(r.doc_a, r.doc_b) for r in found} == {(1, 3)}
    assert " ".join(r.text for r in found if r.op != "insert") == " ".join(base.split())
    assert " ".join(r.text for r in found if r.op != "delete") == " ".join(texts[3].split())


def test_windows_around_hunks():
    from tessera.functions import text as T

    old = "word " * 400 + "alpha " + "word " * 400 + "omega " + "word " * 400
    new = old.replace("alpha", "beta").replace("omega ", "")
    a, b = T.around_hunks(old, new, 1000, 20)
    assert a.count("alpha") == 1 and a.count("omega") == 1 and a.startswith("...") and a.count("\n...\n") == 1 and len(a) < 120
    assert "beta" in b and "\n...\n" not in b and len(b) < 60  # what was taken out leaves nothing to show on this side
    assert T.around_hunks("a b", "a c", 1000, 20) == ("a b", "a c")
    assert T.around_hunks("x " * 600, "x " * 600, 1000, 20) == (("x " * 600)[:1000],) * 2
    assert T.around_hunks("", "y " * 600, 1000, 20)[0] == ""


def test_rendered_diff_and_spans(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text as T

    df = spark.createDataFrame([("a b c", "a x c d"), ("same", "same"), ("", "")], "o string, n string")
    assert [r[0] for r in df.select(T.rendered_diff(T.word_diff("o", "n"))).collect()] == ["a [-b-] {+x+} c {+d+}", "same", "(no word diff)"]
    long = spark.createDataFrame([("w " * 500 + "a", "w " * 500 + "b")], "o string, n string").select(T.rendered_diff(T.word_diff("o", "n"), 10)).first()[0]
    assert long == "w w w w w  ...  w w w w w [-a-] {+b+}"
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in [(5, 9), (0, 3), (0, 5), (4, 6), (9, 9), (9, 11)]])
    assert [(s.start, s.stop) for s in spark.range(1).select(T.greedy_spans(spans)).first()[0]] == [(0, 5), (5, 9), (9, 11)]
    q = spark.createDataFrame([("no later than the 30 days", 18), ("within a b c d e f 30", 19), ("at least and not more than 5", 27), ("5", 0), ("not less than", 8)], "t string, p int")
    assert [r[0] for r in q.select(T.qualifier(F.col("t"), F.col("p"))).collect()] == ["not_more_than", None, "not_more_than", None, None]
    d = spark.createDataFrame([("x Jan. 3, 2001 y 2/4/2002 z",), ("Sept. 9, 1999",), ("2001-02-30",), (None,)], "t string")
    assert [str(r[0]) for r in d.select(T.last_date(F.col("t"))).collect()] == ["2002-02-04", "1999-09-09", "None", "None"]


QUANTITY_CASES = [
    ("Submit within 10 business days of receipt.", ("period", 10, "day", "business", "within")),
    ("a 30-day notice period", ("period", 30, "day", None, None)),
    ("fourteen (14) calendar days", ("period", 14, "day", "calendar", None)),
    ("a $45.00 fee", ("amount", 45, "dollar", None, None)),
    ("affecting 2,500 customers", ("number", 2500, "customer", None, None)),
    ("no later than 30 days", ("deadline", 30, "day", None, "not_more_than")),
    ("at least 24 hours", ("period", 24, "hour", None, "at_least")),
    ("Retain records for 7 years", ("record_retention", 7, "year", None, None)),
    ("Keep for three years", ("record_retention", 3, "year", None, None)),
    ("exceeds 1,000 gallons", ("threshold", 1000, "gallon", None, None)),
    ("every 30 days", ("frequency", 30, "day", None, None)),
    ("ten percent", ("number", 10, "percent", None, None)),
    ("due within 5 business days", ("deadline", 5, "day", "business", "within")),
    ("at least 34 kV", ("threshold", 34, "kv", None, "at_least")),
    ("prior to 60 days", ("period", 60, "day", None, "prior_to")),
    ("not less than 3 hours", ("period", 3, "hour", None, "at_least")),
    ("exactly 15 minutes", ("period", 15, "minute", None, "exactly")),
    ("after 6 months", ("period", 6, "month", None, "after")),
    ("greater than 5000 customers", ("threshold", 5000, "customer", None, None)),
    ("five hundred meters", ("number", 500, "meter", None, None)),
    ("twenty-five percent", ("number", 25, "percent", None, None)),
    ("two years", ("period", 2, "year", None, None)),
    ("a 25 kVA unit", ("number", 25, "kva", None, None)),
    ("$1,200 per event", ("amount", 1200, "dollar", None, None)),
    ("3 working days", ("period", 3, "day", "working", None)),
    ("100 miles", ("number", 100, "mile", None, None)),
    ("5% of load", ("number", 5, "percent", None, None)),
    ("not more than 8 gallons", ("threshold", 8, "gallon", None, "not_more_than")),
]


@pytest.mark.parametrize(("text", "want"), QUANTITY_CASES)
def test_quantities(text, want):
    got = G.find_quantities(text)
    assert [(p["kind"], p["value_num"], p["unit"], p["day_type"], p["qualifier"]) for p in got] == [want]
    assert text[got[0]["start"] : got[0]["stop"]].strip() == got[0]["value_text"]


@pytest.mark.parametrize("text", ["Call 555-1234", "1-800-555-0199", "317-555-0100", "See OBL-0012-0034", "form DCC-F-042", "Sheet No. 45", "version v2.1", "Clause 42 applies", "It is done annually.", ""])
def test_what_is_no_quantity(text):
    assert G.find_quantities(text) == []


CITATION_CASES = [
    ("170 IAC 4-1-16", ["170 IAC 4-1-16"]),
    ("  327 IAC 2-6.1-7 ", ["327 IAC 2-6.1-7"]),
    ("170 IAC 4-1-16(b)(2)(i)", ["170 IAC 4-1-16"]),
    ("170 IAC 4-1-4 through 4-1-14", [f"170 IAC 4-1-{i}" for i in range(4, 15)]),
    ("170 IAC 4-1-4 .. 4-1-6", ["170 IAC 4-1-4", "170 IAC 4-1-5", "170 IAC 4-1-6"]),
    ("170 IAC 4-1-7 through 4-1-7", ["170 IAC 4-1-7"]),
    ("327 IAC 2-6.1", ["327 IAC 2-6.1"]),
    ("federal standard [40 CFR 112]", ["40 CFR 112"]),
    ("29 CFR 1910.269", ["29 CFR 1910.269"]),
    ("IC 14-22-2-1", ["IC 14-22-2-1"]),
    ("42 U.S.C. § 7401", ["42 USC 7401"]),
    ("IEEE C37.90", ["IEEE C37.90"]),
    ("ASTM D877 and NFPA 70", ["ASTM D877", "NFPA 70"]),
    ("some random text", []),
]


@pytest.mark.parametrize(("text", "want"), CITATION_CASES)
def test_citation_forms(text, want):
    assert [c["citation"] for c in G.find_citations(text)] == want
