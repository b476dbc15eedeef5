import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.sources import landed, records
from tessera.streaming import versions

FIELDS = "source_system string, citation string, record_id string, at timestamp, body string"


def put(spark, path, *rows):
    spark.createDataFrame([("cfr", c, i, a, b) for c, i, a, b in rows], FIELDS.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(path)


def take(spark, tmp_path, **more):
    stream = spark.readStream.schema(FIELDS).parquet(f"{tmp_path}/landing")
    versions.take(versions.changes(stream, **more), f"{tmp_path}/out", f"{tmp_path}/cursor")
    return sorted((r.citation, r.record_id or "", r.state, str(r.prior_at or "")[:10], r.n_versions) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_state_survives_restarts_and_late_records(spark, tmp_path):
    put(spark, f"{tmp_path}/landing", ("1", "a", "2024-01-01", "x"), ("1", "b", "2024-02-01", "y"), ("2", "c", "2024-01-01", "x"))
    assert take(spark, tmp_path) == [("1", "a", "new", "", 1), ("1", "b", "changed", "2024-01-01", 2), ("2", "c", "new", "", 1)]
    # a record older than the latest is held against the latest and doesn't replace it
    put(spark, f"{tmp_path}/landing", ("1", "d", "2024-01-15", "x"), ("1", "e", "2024-03-01", "y"), ("2", "f", "2024-01-02", None), ("3", "g", "2024-01-01", ""))
    got = take(spark, tmp_path)
    assert got[3:5] == [("1", "e", "unchanged", "2024-02-01", 3), ("2", "c", "new", "", 1)] and ("1", "d", "changed", "2024-02-01", 3) in got
    assert ("2", "f", "changed", "2024-01-01", 2) in got and ("3", "g", "new", "", 1) in got and len(got) == 7
    assert take(spark, tmp_path) == got  # nothing new: nothing is told again


def test_timers_tell_stale_keys_once(spark, tmp_path):
    put(spark, f"{tmp_path}/landing", ("1", "a", "2024-01-01", "x"), ("2", "b", "2024-01-01", "x"))
    take(spark, tmp_path, late="1 day", stale_days=7)
    put(spark, f"{tmp_path}/landing", ("2", "c", "2024-01-05", "x"))
    take(spark, tmp_path, late="1 day", stale_days=7)
    put(spark, f"{tmp_path}/landing", ("3", "d", "2024-01-11", "x"))
    take(spark, tmp_path, late="1 day", stale_days=7)
    stale = [x for x in take(spark, tmp_path, late="1 day", stale_days=7) if x[2] == "stale"]
    assert stale == [("1", "", "stale", "2024-01-01", 1)]


def test_interval_stitch_in_either_order(spark, tmp_path):
    kinds = {"s": "section_id string, citation string, at timestamp", "a": "action_id string, citation string, published timestamp"}

    def land(name, *rows):
        spark.createDataFrame(rows, kinds[name].replace("timestamp", "string")).withColumn(kinds[name].split()[-2], F.to_timestamp(kinds[name].split()[-2])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def run():
        streams = [spark.readStream.schema(kinds[n]).parquet(f"{tmp_path}/{n}") for n in "sa"]
        versions.take(versions.stitched(*streams, late="30 days", before=7, after=30), f"{tmp_path}/out", f"{tmp_path}/cursor")
        return sorted((r.section_id, r.action_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    land("s", ("s1", "c1", "2024-01-10"), ("s2", "c1", "2024-03-10"), ("s3", "c2", "2024-01-10"))
    land("a", ("a1", "c1", "2024-01-01"))
    assert run() == [("s1", "a1")]
    land("a", ("a2", "c2", "2024-01-12"), ("a3", "c1", "2023-11-01"))
    assert run() == [("s1", "a1"), ("s3", "a2")]


def test_stitching_runs_no_batch_without_data(spark, tmp_path):
    """Two landings are two batches, joined by one store a task; what the session sets for streams stays."""
    for n in (1, 2):
        spark.sql(f"select 's{n}' as section_id, 'c' as citation, timestamp '2024-01-10' as at").write.mode("append").parquet(f"{tmp_path}/s")
        spark.sql(f"select 'a{n}' as action_id, 'c' as citation, timestamp '2024-01-0{n}' as published").write.mode("append").parquet(f"{tmp_path}/a")
        streams = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{k}").schema).parquet(f"{tmp_path}/{k}") for k in "sa"]
        versions.take(versions.stitched(*streams), f"{tmp_path}/out", f"{tmp_path}/cursor", timers=False)
    assert sorted((r.section_id, r.action_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(s, a) for s in ("s1", "s2") for a in ("a1", "a2")]
    assert sorted(f for f in os.listdir(f"{tmp_path}/cursor/commits") if f.isdigit()) == ["0", "1"]
    assert not any(d.startswith(("left-", "right-")) for d in os.listdir(f"{tmp_path}/cursor/state/0/0"))
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def page(tmp_path, source, name, *rows):
    os.makedirs(tmp_path / source, exist_ok=True)
    (tmp_path / source / name).write_bytes(b"\n".join(r if isinstance(r, bytes) else json.dumps(r).encode() for r in rows))


def order(key):
    return {"gao_id": key, "title": f"order {key}"}


def test_failures_stay_where_they_are(spark, tmp_path):
    landed.register(spark)
    page(tmp_path, "iurc_gaos", "1.json", order("a"), b"{broken", order(""), b"[1]", order("b"))
    page(tmp_path, "iurc_gaos", "2.json", b"\xff\xfe bad bytes")
    page(tmp_path, "source_system=cfr", "1.json", {"title_number": 40, "part": "60", "section_number": "1", "amendment_date": "no day"}, {"title_number": 40, "part": "60", "section_number": "2", "amendment_date": "2024-01-01"})
    page(tmp_path, "unknown", "1.json", {})
    page(tmp_path, "iurc_investigations", "1.json", {"cause_number": "1", "date_filed": "9/21/2024"}, {"cause_number": "2", "date_filed": "soon"})
    (tmp_path / "iurc_investigations" / "_down").write_text("0.json")
    got = spark.read.format("landed_pages").option("pageBytes", 30).load(str(tmp_path)).collect()
    told = sorted((r.source_system, r.key or "", (r.error or "").split(":")[0]) for r in got)
    assert told == [("cfr", "", "ValueError"), ("cfr", "40 CFR 60.2", ""), ("iurc_gaos", "", "AttributeError"), ("iurc_gaos", "", "JSONDecodeError"), ("iurc_gaos", "", "unreadable page"), ("iurc_gaos", "a", ""), ("iurc_gaos", "b", ""), ("iurc_investigations", "", "the source is down"), ("unknown", "", "no normaliser for unknown")]
    assert spark.read.format("landed_pages").option("sources", "iurc_gaos").load(str(tmp_path)).where("key is not null").count() == 2
    os.makedirs(tmp_path / "empty")
    assert spark.read.format("landed_pages").load(str(tmp_path / "empty")).count() == 0


def test_stream_takes_each_page_once_and_waits_for_sources_that_are_down(spark, tmp_path):
    landed.register(spark)
    root = tmp_path / "in"

    def run():
        versions.take(spark.readStream.format("landed_pages").load(str(root)).select("source_system", "key"), f"{tmp_path}/out", f"{tmp_path}/cursor")
        return sorted(r.key for r in spark.read.parquet(f"{tmp_path}/out").collect())

    page(root, "iurc_gaos", "1.json", order("a"))
    page(root, "iurc_rulemakings", "1.json", {"rm_number": "r1"})
    landed.mark_down(spark, f"file://{root}/iurc_rulemakings")
    assert run() == ["a"]
    page(root, "iurc_gaos", "2.json", order("b"))
    assert run() == ["a", "b"]
    landed.mark_down(spark, f"file://{root}/iurc_rulemakings", "1.json")
    page(root, "iurc_rulemakings", "2.json", {"rm_number": "r2"})
    assert run() == ["a", "b", "r1"]
    landed.mark_well(spark, f"file://{root}/iurc_rulemakings")
    assert run() == run() == ["a", "b", "r1", "r2"]


@pytest.mark.parametrize(
    ("source", "raw", "want"),
    [
        ("federal_register", {"document_number": "1", "title": "t", "type": "Rule", "action": "Direct Final rule; correction", "agencies": [{"slug": "x"}, {"slug": "federal-energy-regulatory-commission"}], "cfr_references": [{"title": 18, "part": 35}, {"title": 18, "part": 35}, {"title": 1, "part": None}]}, {"action_type": "direct_final_rule", "agency": "ferc", "refs": ["18 CFR 35"], "status": "approved"}),
        ("federal_register", {"document_number": "1", "title": "t", "type": "Proposed Rule", "action": None, "agencies": [{"slug": "environmental-protection-agency"}]}, {"action_type": "proposed_rule", "status": "in_progress"}),
        ("federal_register", {"document_number": "1", "title": "t", "agencies": []}, None),
        ("iac", {"citation": "1 IAC 2", "heading": "Sec. (Repealed)", "snapshot_date": "2024-01-01"}, {"status": "repealed", "kind": "section"}),
        ("iac", {"citation": "1 IAC 2", "snapshot_date": "2024-01-01"}, None),
        ("iurc_rulemakings", {"rm_number": "RM 1", "lsa_number": " 24  100 "}, {"dockets": ["RM 1", "LSA-24-100"], "action_type": "proposed_rule"}),
        ("iurc_rulemakings", {"lsa_number": "24-100"}, None),
        ("idem_rulemakings", {"lsa_id": "24-1", "rule_heading": " Air ", "pdf_type": "second_notice"}, {"body": "Air (second notice)", "dockets": ["24-1"]}),
        ("iurc_gaos", {"gao_id": "2024-01"}, {"title": "2024-01", "action_type": "order", "status": "approved"}),
        ("iurc_investigations", {"cause_number": "45", "date_filed": "9/21/2026", "is_investigation": True}, {"action_type": "commission_investigation", "title": "Cause 45"}),
    ],
)
def test_normalisers(source, raw, want):
    got = records.NORMALISERS[source](raw)
    assert got is None if want is None else {k: got[k] for k in want} == want


def test_a_key_is_told_row_by_row_without_frames():
    class State:
        value = None

        def get(self):
            return self.value

        def update(self, v):  # as a store gives it back: without a zone
            self.value = (v[0], v[1].astimezone().replace(tzinfo=None), v[2])

    day = lambda n: datetime(2024, 1, n, tzinfo=timezone.utc)
    rows = [Row(at=day(n), record_id=i, content_hash=h) for n, i, h in ((3, "c", "y"), (1, "a", "x"), (3, "b", "x"))]
    v = versions.Versions()
    v.latest = State()
    got = list(v.handleInputRows(("s", "k"), iter(rows), None)) + list(v.handleInputRows(("s", "k"), iter([Row(at=day(2), record_id="d", content_hash="x")]), None))
    assert [(r.record_id, r.state, r.prior_at, r.n_versions) for r in got] == [("a", "new", None, 1), ("b", "unchanged", day(1), 1), ("c", "changed", day(3), 2), ("d", "changed", day(3), 3)]


def test_a_group_of_keys_tells_what_each_key_would():
    import random

    import pandas as pd

    rng, held, known = random.Random(1), {}, None
    for batch in range(4):
        rows = [("s", rng.choice(["1", "2", "3", None]), f"{batch}-{i}", rng.randrange(12), rng.choice("xy")) for i in range(rng.choice([1, 25]))]
        want = []
        for c in {r[1] for r in rows}:
            for _, _, i, at, content in sorted((r for r in rows if r[1] == c), key=lambda r: (r[3], r[2])):
                was = held.get(c)
                state = "new" if was is None else "unchanged" if was[0] == content else "changed"
                n = (was[2] if was else 0) + (state != "unchanged")
                want.append((c, i, at, content, state, was and was[1], n))
                held[c] = (was[0], was[1], n) if was and at < was[1] else (content, at, n)
        out, known = versions.told_at_once(pd.DataFrame(rows, columns=["source_system", "citation", "record_id", "at", "content_hash"]), known)
        got = [tuple(None if pd.isna(x) else x for x in r) for r in out.drop(columns="source_system").itertuples(index=False)]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert {(None if pd.isna(k) else k): tuple(v) for k, *v in known[["citation", "content_hash", "at", "n_versions"]].itertuples(index=False)} == held
