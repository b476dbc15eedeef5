import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, profiling
from tessera.sources import files
from tessera.streaming import ingest


def test_csv_nulls_and_types(spark, tmp_path):
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write('id,when,ok,"a.b",text\n1,2024-01-02T03:04:05,true,1.5,NULL\n2,null,None,,"two\nlines"\n')
    df = files.read_csv(spark, str(tmp_path / "x.csv.gz"))
    assert dict(df.dtypes) == {"id": "bigint", "when": "timestamp", "ok": "boolean", "a.b": "double", "text": "string"}
    assert [tuple(r)[2:] for r in df.orderBy("id").collect()] == [(True, 1.5, None), (None, None, "two\nlines")]


def test_register(spark, tmp_path):
    (tmp_path / "r.csv").write_text("obl_id,what,note\nOBL-1,report,\n,inspect,x\n")
    rows = {r.text: r for r in files.read_register(spark, str(tmp_path / "r.csv"), "obl_id").collect()}
    assert rows["obl_id: OBL-1\nwhat: report"].clause_id == "OBL-1"
    assert rows["what: inspect\nnote: x"].clause_id.startswith("ROW_")


def test_front_matter(spark, tmp_path):
    for name, text in {"a.md": "---\nTitle: One\nowner: x: y\n---\nBody", "b.md": "<!--\ntitle: Two\n-->\nBody", "c.md": "No front\n---\nBody"}.items():
        (tmp_path / name).write_text(text)
    rows = {r.path[-4:]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.md"].meta == {"title": "One", "owner": "x: y"} and rows["a.md"].body == "Body"
    assert rows["b.md"].meta == {"title": "Two"} and rows["c.md"].meta == {} and rows["c.md"].body_start == 0


def test_collect_and_write_once(spark, tmp_path):
    for n in ("a.md", "b.csv", "secret.md"):
        (tmp_path / n).write_text(n)
    found = files.collect_files(spark, str(tmp_path), [r"\.(md|csv)$"], ["secret"])
    assert {(r.name, r.profile, r.size) for r in found.collect()} == {("a.md", "text", 4), ("b.csv", "table", 5)}
    stored = spark.createDataFrame([("a.md", "other")], "name string, sha256 string")
    new, clash = files.write_once(found, stored)
    assert [r.name for r in new.collect()] == ["b.csv"] and [r.name for r in clash.collect()] == ["a.md"]


def test_xml_json_snapshot(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<ROOT><DIV8 N="35.1" TYPE="SECTION"><HEAD> Scope </HEAD><P>One.</P><P>Two.</P></DIV8><DIV8 N="x" TYPE="APPENDIX"><HEAD>no</HEAD></DIV8></ROOT>')
    assert [tuple(r) for r in files.read_sections_xml(spark, str(tmp_path / "t.xml")).collect()] == [("35.1", "Scope", "One.\nTwo.")]
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"document_number": "1", "publication_date": "2024-01-01"}, {"document_number": "2", "publication_date": "2025-01-01"}]}))
    assert [r.document_number for r in files.read_register_json(spark, str(tmp_path / "p.json"), "2024-06-01").collect()] == ["2"]
    files.write_snapshot(spark.createDataFrame([("b", 1), ("a", 2)], "k string, v int"), str(tmp_path / "snap"), "k", ("v",))
    assert [r.k for r in spark.read.json(str(tmp_path / "snap")).orderBy("k").collect()] == ["a", "b"]


def test_streamed_versions(spark, tmp_path):
    land, store, check = (str(tmp_path / x) for x in ("land", "store", "check"))

    def drop(name, *rows):
        (tmp_path / "land").mkdir(exist_ok=True)
        (tmp_path / "land" / name).write_text("\n".join(json.dumps(dict(zip(("source_system", "citation", "snapshot_date", "body", "status"), r, strict=True))) for r in rows))

    drop("1.json", ("cfr", "1", "2024-01-01", "a", "approved"), ("cfr", "2", "2024-01-01", "b", "approved"), ("cfr", "3", None, "c", "approved"), ("cfr", "4", "2024-01-01", "c", "odd"))
    assert ingest.ingest(spark, land, store, check) == {"new": 2, "changed": 0, "unchanged": 0, "rejected": 2}
    drop("2.json", ("cfr", "1", "2024-02-01", "a", "approved"), ("cfr", "2", "2024-02-01", "B", "approved"), ("cfr", "5", "2024-02-01", "z", "repealed"))
    assert ingest.ingest(spark, land, store, check) == {"new": 1, "changed": 1, "unchanged": 1, "rejected": 0}
    assert ingest.ingest(spark, land, store, check) == {"new": 0, "changed": 0, "unchanged": 0, "rejected": 0}
    rows = ingest.read_store(spark, store).where("citation = '2'").orderBy("snapshot_date").collect()
    assert [(r.body, r.state, str(r.prior_date)) for r in rows] == [("b", "new", "None"), ("B", "changed", "2024-01-01")]


def test_stream_dedup_and_windows(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.json").write_text('{"id": 1, "ts": "2024-01-01T00:10:00"}\n{"id": 1, "ts": "2024-01-01T00:10:00"}\n{"id": 2, "ts": "2024-01-01T05:00:00"}')
    stream = spark.readStream.schema("id long, ts timestamp").json(str(tmp_path / "e"))
    for name, df, mode, want in (("once", ingest.distinct_events(stream, "id", "ts"), "append", 2), ("wide", ingest.windowed_counts(stream, "ts", "id"), "complete", 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == want


def test_restitch_keeps_old_links(spark):
    sections = spark.createDataFrame([("1", "2024-02-01"), ("2", "2024-02-01")], "citation string, snapshot_date string").withColumn("snapshot_date", F.to_date("snapshot_date"))
    actions = spark.createDataFrame([("1", "x", "2024-01-15"), ("2", "y", "2020-01-01"), ("1", "w", "2024-01-15")], "citation string, action_id string, published string").withColumn("published", F.to_date("published"))
    links = spark.createDataFrame([("1", "kept")], "citation string, action_id string")
    assert [tuple(r) for r in ingest.restitched(sections, actions, links).collect()] == [("1", "kept")]
    assert [tuple(r) for r in ingest.restitched(sections, actions, links.limit(0)).collect()] == [("1", "w")]


def test_checks_refuse_and_report(spark):
    spark.createDataFrame([(i, v) for i, v in enumerate([10, 30, 55, 70, 90, 45, 80], 1)], "id long, value int").createOrReplaceTempView("checked")
    assert profiling.refuse("drop table x") and profiling.refuse("select 1; select 2") and profiling.refuse("with a as (select 1) delete from x")
    assert profiling.refuse("select 'drop; it' as x") is None
    found = profiling.run_check(spark, "select * from checked where value > :most", {"most": 60})
    assert (found["status"], found["n"], len(found["sample"])) == ("violations", 3, 3)
    assert profiling.run_check(spark, "select * from checked where value > 1000")["status"] == "ok"
    assert profiling.run_check(spark, "select nothing from checked")["status"] == "error"


def test_as_of_with_ties_and_hot_keys(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1), (None, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 7, "c"), (3, 0, "d")], "k int, u int, v string")
    assert {(r.k, r.t): r.v for r in joins.as_of(left, right, ["k"], "t", "u", ["v"]).collect()} == {(1, 5): "b", (1, 10): "c", (2, 1): None, (None, 3): None}


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_in_buckets(spark, forward):
    """A key of very many rows, split by time, gives what the whole window gives."""
    import random

    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 300), i) for i in range(300)], "k int, t int, i int")
    right = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 300), f"v{i}") for i in range(60)], "k int, u int, v string")
    whole, split = (joins.as_of(left, right, ["k"], "t", "u", ["v"], forward, b) for b in (None, lambda at: F.floor(at / 7)))
    assert sorted(map(tuple, whole.select("i", "v").collect())) == sorted(map(tuple, split.select("i", "v").collect()))
    assert whole.where("v is not null").count() > 200


def test_name_based_ids(spark):
    import uuid

    names = ["", "a", "clause|basis|1 IAC 2-3", "é"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(files.uuid5(str(uuid.NAMESPACE_URL), F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_people_attributes_and_reports(spark, tmp_path):
    (tmp_path / "p.csv").write_text('person_id,roles,verticals\n1," a; b ;;",\n2,,"x"\n')
    assert [tuple(r) for r in files.read_people(spark, str(tmp_path / "p.csv")).orderBy("person_id").collect()] == [("1", ["a", "b"], []), ("2", [], ["x"])]
    (tmp_path / "c.yaml").write_text("name: x\n\napplicability_attributes:\n  a: true\n  b: No  # why\n\n  # a note\n  c: 5.5\n  d: 'yes'\n  e: some text\nnext:\n  f: 1\n")
    got = {r.key: (r.value_text, r.value_num, r.value_bool) for r in files.read_attributes(spark, str(tmp_path / "c.yaml")).collect()}
    assert got == {"a": ("True", None, True), "b": ("False", None, False), "c": ("5.5", 5.5, None), "d": ("yes", None, None), "e": ("some text", None, None)}
    checks = spark.createDataFrame([("c", 0, True)], "check_name string, n_violations long, passed boolean")
    files.write_report(spark.createDataFrame([("n", 3)], "name string, n long"), spark.createDataFrame([("x", "m"), ("x", "l")], "code string, message string"), checks, str(tmp_path / "r"))
    report = json.loads(next((tmp_path / "r").glob("part-*.json")).read_text())
    assert report == {"stats": {"n": 3}, "issues": [{"code": "x", "n": 2, "first": "l"}], "checks": [{"check_name": "c", "n_violations": 0, "passed": True}], "passed": True}
