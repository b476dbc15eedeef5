from pyspark.sql import functions as F

from tessera.operators import checks as C


def test_each_kind_of_check(spark):
    a = spark.createDataFrame([(1, "x", 5.0, 1, 2), (2, None, 7.0, 3, None), (2, "z", -1.0, 4, 3), (9, "x", 9.0, None, 1)], "k int, kind string, v double, t1 int, t2 int")
    b = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 7.0)], "k int, part double")
    now = spark.createDataFrame([(1, "x"), (2, "changed"), (3, "new")], "k int, kind string")
    base = spark.createDataFrame([(1, "x"), (2, "z"), (8, None)], "k int, kind string")
    size = spark.createDataFrame([(1, 1), (2, 5)], "k int, n int")
    suite = [
        C.domain("domain", "a", "kind", "x", "y"),
        C.matches("form", "a", "kind", "^[xyz]$"),
        C.implies("implies", "a", F.col("kind") == "x", F.col("v") > 6),
        C.ordered("ordered", "a", "t1", "t2"),
        C.rows("rows", "a", F.col("v") > 0),
        C.unique("unique", "a", "k"),
        C.foreign("foreign", "a", "k", "b", "k"),
        C.has_some("some", "a", "k", "b", "k", "part > 4"),
        C.unchanged("unchanged", "base", "now", ["k"], ["kind"]),
        C.totals("totals", "a", "k", F.col("v"), "b", "k", F.col("part"), 0.01),
        C.at_most("at most", "b", "k", "size", "k", F.col("n")),
        C.measured("share", "a", F.avg("v"), 4, 6),
        C.measured("none", "empty", F.avg("v"), None, None),
    ]
    tables = {"a": a, "b": b, "base": base, "now": now, "size": size, "empty": a.limit(0)}
    got = {r.check_name: r.n_violations for r in C.run_suite(suite, tables).collect()}
    assert got == {"domain": 2, "form": 1, "implies": 1, "ordered": 1, "rows": 1, "unique": 1, "foreign": 1, "some": 2, "unchanged": 2, "totals": 2, "at most": 1, "share": 0, "none": 1}
    by_name = {c.name: c for c in suite}
    assert [r.v for r in C.shown(by_name["rows"], tables).collect()] == [-1.0] and C.shown(by_name["foreign"], tables).first().k == 9
    assert C.shown(by_name["domain"], tables, 1).count() == 1


def test_empty_tables_have_no_violations(spark):
    a = spark.createDataFrame([], "k int, v double")
    got = C.run_suite([C.rows("r", "a", F.col("v") > 0), C.unique("u", "a", "k"), C.foreign("f", "a", "k", "a", "k")], {"a": a}).collect()
    assert [(r.n_violations, r.passed) for r in got] == [(0, True)] * 3
