from datetime import datetime

from tessera.plans import relational, suites, textual


def test_links_of_a_node_with_itself_stay(spark):
    l = spark.createDataFrame([(1000005, 5), (1000005, 5), (7, 5), (1000007, 5)], "l_partkey long, l_suppkey long")
    got = sorted(map(tuple, relational.links_both_ways(lambda _: l, spark).collect()))
    assert got == [(7, 1000005), (1000005, 7), (1000005, 1000005), (1000005, 1000007), (1000007, 1000005)]


def test_gaps_are_counted_between_full_seconds(spark):
    at = [datetime(2024, 1, 1, 0, 0, 0, 900_000), datetime(2024, 1, 1, 2, 30, 1, 100_000), datetime(2024, 1, 1, 5, 0, 1, 900_000)]
    e = spark.createDataFrame([(i, t, 1, "view", 1.0, None) for i, t in enumerate(at)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    c = spark.createDataFrame([(1,)], "c_custkey long")
    found = {r.check_name: r.n_violations for r in suites.spill_checks(lambda name: {"events": e, "customer": c}[name], spark).collect()}
    assert found["AT-07 window"] == 1


def test_references_that_were_cut_stay_as_they_stand(spark):
    html = "<title>a &amp;&lt&#38 b&amp</title><a href='?a=1&b=2'>x</a><h1>c &amp; d&copy</h1>&amp;amp &quot;e&quot;"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = sorted(map(tuple, textual.page_sections(lambda _: pages, spark).collect()))
    assert got == [(1, 0, "", "a &&lt&#38 b&amp x"), (1, 1, "c & d&copy", '&amp "e"'), (2, 0, "", "")]
