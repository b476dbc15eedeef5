"""Sources, sinks and streams over whole tables: rows are landed as files in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import grammar as G
from tessera.functions import tables
from tessera.functions import text as T
from tessera.operators import joins, profiling
from tessera.operators.stages import spread
from tessera.registry import query
from tessera.sources import files, landed, markdown
from tessera.streaming import ingest as S
from tessera.streaming import versions as V


@query("A2_xml_sections", "select 'sec ' || p_partkey as citation, p_name as heading, 'size ' || p_size || chr(10) || p_brand as body from part where p_size % 3 <> 0")
def xml_sections(t, spark):
    rows = t("part").select(F.concat(F.lit("sec "), F.col("p_partkey").cast("string")).alias("_N"), F.when(F.col("p_size") % 3 == 0, "SUBPART").otherwise("SECTION").alias("_TYPE"), F.col("p_name").alias("HEAD"), F.array(F.concat(F.lit("size "), F.col("p_size").cast("string")), "p_brand").alias("P"))
    path = files.landing_dir(spark)
    rows.write.format("xml").option("rowTag", "DIV8").option("rootTag", "ECFR").save(path)
    return files.read_sections_xml(spark, path)


@query("A3_register_json", "select cast(o_orderkey as varchar) as document_number, o_orderpriority as title, cast(o_orderdate as date) as publication_date from orders where o_orderdate >= timestamp '1996-01-01'")
def register_json(t, spark):
    """Pages of a thousand results, a file each, and of these the ones published from a day on."""
    row = F.struct(F.col("o_orderkey").cast("string").alias("document_number"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"))
    path = files.landing_dir(spark)
    t("orders").groupBy(F.expr("o_orderkey div 1000").alias("page")).agg(F.collect_list(row).alias("results")).write.partitionBy("page").json(path)
    return files.read_register_json(spark, path, "1996-01-01").select("document_number", "title", "publication_date")


@query("A14_register", "select 'C-' || p_partkey as clause_id, cast(4 - (case when p_size % 4 = 0 then 1 else 0 end) as bigint) as n_cells, p_partkey from part")
def register(t, spark):
    path = files.landing_dir(spark)
    t("part").select(F.concat(F.lit("C-"), F.col("p_partkey").cast("string")).alias("clause_id"), "p_partkey", "p_name", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("p_size")).write.csv(path, header=True)
    return files.read_register(spark, path, "clause_id").select("clause_id", F.size("row_cells").cast("long").alias("n_cells"), F.col("row_cells")["p_partkey"].cast("long").alias("p_partkey"))


@query("A15_dataset_csv", "select o_orderkey, case when o_orderkey % 4 <> 0 then o_custkey end as o_custkey, round(o_totalprice, 2) as o_totalprice, cast(o_orderdate as timestamp) as o_orderdate from orders")
def dataset_csv(t, spark):
    """Compressed CSV with several words for null; the reader finds numbers and times."""
    null = F.get(F.array(F.lit("NULL"), F.lit("null"), F.lit("None"), F.lit("")), (F.expr("o_orderkey div 4") % 4).cast("int"))
    path = files.landing_dir(spark)
    t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, null).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"), F.round("o_totalprice", 2).alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("o_orderdate")).write.csv(path, header=True, compression="gzip")
    return files.read_csv(spark, path).select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


def front_matter(t, spark):
    """A file for each nation, with its front matter in one of three styles."""
    text = F.format_string("%s\ntitle: %s\nid: %d\n%s\nbody of %s", F.col("head"), "n_name", "n_nationkey", F.col("tail"), "n_name")
    mark = lambda a, b, c: F.get(F.array(*[F.lit(x) for x in (a, b, c)]), (F.col("n_nationkey") % 3).cast("int"))
    path = files.landing_dir(spark)
    n = t("nation").withColumns({"head": mark("---", "<!--", "+++"), "tail": mark("---", "-->", "+++")})
    n.select("n_nationkey", text.alias("value")).write.partitionBy("n_nationkey").text(path)
    return path


@query("A16_front_matter", "select n_name as title, cast(n_nationkey as varchar) as id, 'body of ' || n_name as body from nation")
def front_matter_documents(t, spark):
    df = files.read_documents(spark, front_matter(t, spark))
    return df.select(F.col("meta")["title"].alias("title"), F.col("meta")["id"].alias("id"), F.rtrim(F.regexp_replace("body", r"\n+$", "")).alias("body"))


@query("A17_collected_files", "select 'text' as profile, count(*) as n from nation where n_nationkey <> 7")
def collected_files(t, spark):
    """Allowed files without denied ones, by kind; a deny goes before an allow."""
    return files.collect_files(spark, front_matter(t, spark), [r"\.txt$"], [r"n_nationkey=7/"]).groupBy("profile").agg(F.count("*").alias("n"))


@query("A18_register_sniff", "select 'p_partkey' as key_column, true as is_register")
def register_sniff(t, spark):
    """A table is a register if its first column's name ends like a key and all values are shaped like ids."""
    first = t("part").columns[0]
    shaped = t("part").agg(F.bool_and(F.col(first).cast("string").rlike(r"^[A-Za-z]*-?\d+$")).alias("shaped"))
    return shaped.select(F.lit(first).alias("key_column"), (F.col("shaped") & F.lit(first.endswith(("key", "_id")))).alias("is_register"))


@query("A19_reference_lists", "select c_custkey, count(*) as n_roles from customer, (select unnest(generate_series(0, 2)) as i) where i <= c_custkey % 3 group by 1")
def reference_lists(t, spark):
    """Lists in one cell, parted by semicolons."""
    cell = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int")), lambda i: F.concat(F.lit("role "), i.cast("string"))), "; ")
    return t("customer").select("c_custkey", F.explode(F.split(cell, r"\s*;\s*")).alias("role")).groupBy("c_custkey").agg(F.count("*").alias("n_roles"))


@query("A8_packet_names", "select o_orderkey, cast(o_orderdate as date) as day, 24 * 1000 + o_custkey % 1000 as lsa, case when o_orderstatus = 'F' then 'final' else 'proposed' end as kind from orders")
def packet_names(t, spark):
    """Day, document number and kind from a packet's file name."""
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_LSA24-"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.when(F.col("o_orderstatus") == "F", "_Final").otherwise("_Proposed"), F.lit(".pdf"))
    form = r"^(\d{8})_LSA(\d+)-(\d+)_(\w+)\.pdf$"
    df = t("orders").select("o_orderkey", name.alias("name"))
    part = lambda i: F.regexp_extract("name", form, i)
    return df.select("o_orderkey", F.to_date(part(1), "yyyyMMdd").alias("day"), (part(2).cast("long") * 1000 + part(3).cast("long")).alias("lsa"), F.lower(part(4)).alias("kind"))


@query("A9_normalised", "select o_orderkey, upper(trim(o_orderpriority)) as priority, o_orderstatus as status from orders where o_orderstatus <> 'P' and o_totalprice > 0")
def normalised(t, spark):
    """Raw records as canonical rows; a record that lacks what it must have gives none."""
    raw = t("orders").select(F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("priority"), F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")), F.lit("status"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).alias("r"), "o_totalprice")
    return raw.where("r['status'] is not null and o_totalprice > 0").select(F.col("r")["id"].cast("long").alias("o_orderkey"), F.upper(F.trim(F.col("r")["priority"])).alias("priority"), F.col("r")["status"].alias("status"))


@query("A12_gated_sources", "select n_name as source, count(c_custkey) as n, n_nationkey % 5 <> 0 as healthy from nation left join customer on c_nationkey = n_nationkey and n_nationkey % 5 <> 0 group by 1, 3")
def gated_sources(t, spark):
    """Every source with what it gave; sources that aren't well give nothing and don't stop the others."""
    n = t("nation").select(F.col("n_name").alias("source"), F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") % 5 != 0).alias("healthy"))
    got = t("customer").join(n.where("healthy"), "c_nationkey").groupBy("source").agg(F.count("*").alias("n"))
    return n.join(got, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), "healthy")


@query("A21_parquet_sink", "select count(*) as n, cast(sum(l_quantity) as bigint) as quantity from lineitem")
def parquet_sink(t, spark):
    path = files.landing_dir(spark)
    files.write_dataset(t("lineitem").select("l_orderkey", "l_quantity"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("A22_snapshot", "select p_partkey, p_name from part")
def snapshot(t, spark):
    path = files.landing_dir(spark)
    files.write_snapshot(t("part").select("p_partkey", "p_name", "p_brand"), path, "p_partkey", ("p_brand",))
    return spark.read.schema("p_partkey long, p_name string").json(path)


@query("A23_write_once", "select 'write' as outcome, count(*) as n from orders where o_orderkey % 3 = 0 union all select 'conflict', count(*) from orders where o_orderkey % 3 = 1 and o_orderstatus = 'F'")
def stored_once(t, spark):
    """Objects that are stored already with the same digest are skipped, with another one they conflict."""
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("name"), F.sha2("o_orderstatus", 256).alias("sha256"), "o_orderkey")
    stored = o.where("o_orderkey % 3 <> 0").select("name", F.when(F.col("o_orderkey") % 3 == 1, F.sha2(F.lit("O"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    new, bad = files.write_once(o, stored)
    bad = bad.where(F.col("sha256") == F.sha2(F.lit("F"), 256))
    return new.agg(F.lit("write").alias("outcome"), F.count("*").alias("n")).unionByName(bad.agg(F.lit("conflict").alias("outcome"), F.count("*").alias("n")))


@query("A29_run_report", "select 'orders' as part, count(*) as n, count_if(o_totalprice <= 0) as n_issues from orders union all select 'lineitem', count(*), count_if(l_quantity > 50) from lineitem")
def run_report(t, spark):
    row = lambda name, df, bad: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.count_if(F.expr(bad)).alias("n_issues"))
    return row("orders", t("orders"), "o_totalprice <= 0").unionByName(row("lineitem", t("lineitem"), "l_quantity > 50"))


def records(t):
    """Orders as section records of their customer, one in eleven without a date."""
    key = F.col("o_orderkey")
    return t("orders").select(F.lit("iac").alias("source_system"), F.concat(F.lit("sec "), key.cast("string")).alias("citation"), F.when(key % 11 != 0, F.to_date("o_orderdate")).alias("snapshot_date"), F.concat(F.lit("body "), F.col("o_orderstatus")).alias("body"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("approved").alias("status"))


@query("K5_isolated_errors", "select coalesce(case when o_orderkey % 11 = 0 then 'date' when o_orderstatus = 'P' then 'status' end, 'good') as reason, count(*) as n from orders group by 1")
def isolated_errors(t, spark):
    good, bad = S.validated(records(t))
    return good.withColumn("reason", F.lit("good")).unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"))


@query("K1_streamed_versions", "select count(*) as n, cast(count_if(o_orderkey % 2 = 0) as bigint) as n_changed from orders where o_orderkey % 11 <> 0 and o_orderstatus <> 'P'")
def streamed_versions(t, spark):
    """Two landings taken by a stream: all sections, then later texts of every second one; the checkpoint is the cursor."""
    root = files.landing_dir(spark)
    first = records(t)
    first.write.json(f"{root}/landing")
    S.ingest(spark, f"{root}/landing", f"{root}/store", f"{root}/cursor")
    later = first.where("cast(substring(citation, 5) as long) % 2 = 0").withColumns({"snapshot_date": F.date_add("snapshot_date", 30), "body": F.concat("body", F.lit(" amended"))})
    later.write.mode("append").json(f"{root}/landing")
    S.ingest(spark, f"{root}/landing", f"{root}/store", f"{root}/cursor")
    store = S.read_store(spark, f"{root}/store")
    return store.agg(F.countDistinct("citation").alias("n"), F.count_if(F.col("state") == "changed").alias("n_changed"))


@query("K4_restitched", "select 'sec ' || o_orderkey as citation, case when o_orderkey % 4 = 0 then -1 else o_custkey end as action_id from orders where o_orderkey % 4 = 0 or o_orderkey % 4 = 1")
def restitched(t, spark):
    """Sections that came before their actions are linked afterwards; older links stay."""
    o = t("orders").select(F.concat(F.lit("sec "), F.col("o_orderkey").cast("string")).alias("citation"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").cast("long").alias("action_id"), (F.col("o_orderkey") % 4).alias("r"))
    gap = F.when(F.col("r") < 2, 10).otherwise(500)
    unlinked = o.select("citation", F.date_add("day", gap).alias("snapshot_date"))
    links = o.where("r = 0").select("citation", F.lit(-1).cast("long").alias("action_id"))
    return S.restitched(unlinked, o.select("citation", "action_id", F.col("day").alias("published")), links)


@query("L9_one_to_many", "select o_orderkey, cast(1 + o_orderkey % 5 as bigint) as n from orders")
def one_to_many(t, spark):
    """A table function as a generator: every citation of a list is a row."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int")), lambda i: F.concat(F.lit("170 IAC 4-1-"), i.cast("string"))), "; ")
    return t("orders").select("o_orderkey", F.explode(G.citations(text)).alias("c")).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("B24_cell_citations", "select p_partkey, format('{} IAC {}-1-{}', p_size, p_partkey % 9 + 1, p_partkey % 40 + 1) as citation from part where p_size % 2 = 0")
def cell_citations(t, spark):
    """Every cell of a register is looked through, in the order of its columns."""
    cite = F.format_string("under %d IAC %d-1-%d here", "p_size", F.col("p_partkey") % 9 + 1, F.col("p_partkey") % 40 + 1)
    cells = F.array(F.struct(F.lit(1).alias("at"), F.col("p_name").alias("cell")), F.struct(F.lit(2).alias("at"), F.when(F.col("p_size") % 2 == 0, cite).alias("cell")))
    df = t("part").select("p_partkey", F.explode(cells).alias("c")).where("c.cell is not null")
    return df.select("p_partkey", F.explode(G.citations("c.cell")).alias("x")).select("p_partkey", "x.citation")


@query("B18_matrix_filter", "select l_suppkey, l_partkey, count(*) as n from lineitem where l_linestatus = 'F' and l_returnflag <> 'N' group by 1, 2")
def matrix_filter(t, spark):
    """Cells of changes in the footprint; noise is left out where asked."""
    show_noise = False
    l = t("lineitem").where("l_linestatus = 'F'")
    return (l if show_noise else l.where("l_returnflag <> 'N'")).groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))


@query("B21_section_tree", "select p_brand as chapter, count(*) as n from part where p_size % 10 <> 0 and contains(lower(p_name), 'red') group by 1")
def section_tree(t, spark):
    """Sections by chapter without repealed ones, those whose heading has a text."""
    return t("part").where((F.col("p_size") % 10 != 0) & F.lower("p_name").contains("red")).groupBy(F.col("p_brand").alias("chapter")).agg(F.count("*").alias("n"))


@query("C15_ordered_references", """with r as (select l_orderkey, l_partkey, min(l_linenumber) as first_line from lineitem group by 1, 2) select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by first_line, l_partkey) as place from r join part on p_partkey = l_partkey""")
def ordered_references(t, spark):
    """References of an action in the order of their first mention, once each, that name a section that exists."""
    refs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    kept = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").groupBy("l_orderkey").agg(F.array_distinct(F.transform(refs, lambda r: r["l_partkey"])).alias("r"))
    return kept.select("l_orderkey", F.posexplode("r").alias("at", "l_partkey")).select("l_orderkey", "l_partkey", (F.col("at") + 1).alias("place"))


@query("C18_three_passes", "select o_orderkey, coalesce(case when o_orderkey % 5 = 0 then c_custkey end, case when o_orderkey % 5 in (1, 2) then c_nationkey end, case when o_orderkey % 5 = 3 then -1 end) as target from orders join customer on c_custkey = o_custkey where o_orderkey % 5 < 4")
def three_passes(t, spark):
    """Links in three passes of falling strength; what is linked stays, so that running it again changes nothing."""
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey")
    r = F.col("o_orderkey") % 5
    passes = [o.where(r == 0).select("o_orderkey", F.col("c_custkey").cast("long").alias("target")), o.where(r <= 2).select("o_orderkey", F.col("c_nationkey").cast("long").alias("target")), o.where(r <= 3).select("o_orderkey", F.lit(-1).cast("long").alias("target"))]
    links = passes[0]
    for found in [*passes[1:], passes[0]]:
        links = joins.upsert(links, found, ["o_orderkey"], keep_old=True)
    return links


@query("L4_validated_checks", "select n_name, count_if(c_acctbal < -500) as n_violations, count_if(c_acctbal < -500) = 0 as valid from customer join nation on n_nationkey = c_nationkey group by 1")
def validated_checks(t, spark):
    """A check with values bound from the documents must find nothing in the data as it was."""
    bound = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.lit(-500).alias("least"))
    bad = F.count_if(F.col("c_acctbal") < F.col("least"))
    return t("customer").join(bound, "c_nationkey").groupBy("n_name").agg(bad.alias("n_violations"), (bad == 0).alias("valid"))


@query("O4_outage_suite", "select 'T1 bounds' as check_name, count_if(l_quantity not between 1 and 50) as n_violations, count_if(l_quantity not between 1 and 50) = 0 as passed from lineitem union all select 'T2 steps', count(*), count(*) = 0 from (select o_orderkey from orders left join lineitem on l_orderkey = o_orderkey group by 1 having count(l_orderkey) = 0) union all select 'T3 owner', count(*), count(*) = 0 from orders where o_custkey not in (select c_custkey from customer) union all select 'T4 status', count(*), count(*) = 0 from orders where o_orderstatus not in ('F', 'O', 'P')")
def outage_suite(t, spark):
    o, l = t("orders"), t("lineitem")
    bare = o.join(l.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    lost = o.join(t("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    checks = {"T1 bounds": l.where(~F.col("l_quantity").between(1, 50)), "T2 steps": bare, "T3 owner": lost, "T4 status": o.where(~F.col("o_orderstatus").isin("F", "O", "P"))}
    out = None
    for name, bad in checks.items():
        row = profiling.assert_empty(name, bad)
        out = row if out is None else out.unionByName(row)
    return out


@query("O7_safety_suite", "select 'AT-1 times' as check_name, count_if(ts is null) as n_violations, count_if(ts is null) = 0 as passed from events union all select 'AT-2 kinds', count_if(event_type is null), count_if(event_type is null) = 0 from events union all select 'AT-3 ids', count(*) - count(distinct event_id), count(*) = count(distinct event_id) from events")
def safety_suite(t, spark):
    e = t("events")
    again = e.groupBy("event_id").agg((F.count("*") - 1).alias("k")).where("k > 0").select(F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i"))
    return profiling.assert_empty("AT-1 times", e.where("ts is null")).unionByName(profiling.assert_empty("AT-2 kinds", e.where("event_type is null"))).unionByName(profiling.assert_empty("AT-3 ids", again))


@query("D21_citation_agreement", "select round(avg(case when l_partkey % 50 = l_suppkey % 50 then 1.0 else 0.0 end), 6) as share, count(*) as n from lineitem")
def citation_agreement(t, spark):
    return t("lineitem").agg(F.round(F.avg(F.when(F.col("l_partkey") % 50 == F.col("l_suppkey") % 50, 1.0).otherwise(0.0)), 6).alias("share"), F.count("*").alias("n"))


@query("I10_window", "select doc_id, sha256(case when length(text) <= 1200 then text else substring(text, 1, 600) || ' ... ' || substring(text, length(text) - 599) end) as digest from documents where text is not null")
def window(t, spark):
    """A long text is shown by its two ends, as around a diff's first and last hunk."""
    n = F.length("text")
    shown = F.when(n <= 1200, F.col("text")).otherwise(F.concat(F.substring("text", 1, 600), F.lit(" ... "), F.substring(F.col("text"), n - 599, F.lit(600))))
    return t("documents").where("text is not null").select("doc_id", F.sha2(shown, 256).alias("digest"))


@query("M11_diff_spans", "select o_orderkey, length('old rule ' || o_custkey) + 1 + 4 as start from orders")
def diff_spans(t, spark):
    """Where a quote of the new text lies in the diff, which has the old text first."""
    old = F.concat(F.lit("old rule "), F.col("o_custkey").cast("string"))
    new = F.concat(F.lit("The utility shall file "), F.col("o_orderkey").cast("string"))
    span = G.quote_span(new, F.lit("utility shall file"))
    return t("orders").select("o_orderkey", old.alias("old"), span.alias("s")).select("o_orderkey", (F.length("old") + 1 + F.col("s.start")).cast("long").alias("start"))


@query("I7_ui_diff", "select o_orderkey, 'delete' as op, cast(o_custkey as varchar) as text from orders where o_custkey <> o_orderkey union all select o_orderkey, 'insert', cast(o_orderkey as varchar) from orders where o_custkey <> o_orderkey")
def ui_diff(t, spark):
    """What was deleted and inserted, as the page marks it."""
    text = lambda c: F.concat(F.lit("within "), F.col(c).cast("string"), F.lit(" days of notice"))
    s = t("orders").select("o_orderkey", F.explode(T.word_diff(text("o_custkey"), text("o_orderkey"))).alias("s"))
    return s.where("s.op <> 'equal'").select("o_orderkey", "s.op", "s.text")


#: Lineitems as snapshots of their parts: two landings, the ones numbered 7 late in the second.
LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y%m%d'))"
SNAPSHOTS = f"select l_partkey, l_shipdate as taken, {LINE_ID} as id, l_returnflag || l_linestatus || (l_quantity > 25) as body, case when l_linenumber = 7 or l_shipdate >= timestamp '1998-01-01' then 2 else 1 end as landing from lineitem"
STITCH_DAYS = 60


def line_id():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")], F.date_format("l_shipdate", "yyyyMMdd"))


def section_snapshots(t):
    late = (F.col("l_linenumber") == 7) | (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
    return t("lineitem").select(F.lit("cfr").alias("source_system"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("citation"), line_id().alias("record_id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.concat("l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).cast("string")).alias("body"), F.when(late, 2).otherwise(1).alias("landing"))


@query("K2_state_by_key", f"""with r as ({SNAPSHOTS}), o as (select *, row_number() over (partition by l_partkey order by landing, taken, id) as i from r),
p as (select *, arg_max(body, (taken, i)) over w as old, max(taken) over w as old_at from o window w as (partition by l_partkey order by i rows between unbounded preceding and 1 preceding)),
s as (select *, case when old is null then 'new' when old = body then 'unchanged' else 'changed' end as state from p)
select 'part ' || l_partkey as citation, id as record_id, taken as taken_at, state, old_at as prior_at, cast(count_if(state <> 'unchanged') over (partition by l_partkey order by i) as bigint) as n_versions from s""")
def state_by_key(t, spark):
    """Two landings taken by a stream that is started anew for the second: what is known of a key is one row of state."""
    root = files.landing_dir(spark)
    rows = section_snapshots(t)
    for n in (1, 2):
        rows.where(f"landing = {n}").drop("landing").write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(rows.drop("landing").schema).parquet(f"{root}/landing")
        V.take(V.changes(stream), f"{root}/changes", f"{root}/cursor")
    return spark.read.parquet(f"{root}/changes").select("citation", "record_id", F.col("at").cast("timestamp_ntz").alias("taken_at"), "state", F.col("prior_at").cast("timestamp_ntz").alias("prior_at"), "n_versions")


@query("K4_interval_stitch", f"select {LINE_ID} as section_id, o_orderkey as action_id from lineitem left join orders on o_orderkey = l_orderkey and l_shipdate >= o_orderdate - interval 7 days and l_shipdate <= o_orderdate + interval {STITCH_DAYS} days")
def interval_stitch(t, spark):
    """Sections that land before half of their actions: two streams joined within an interval, by a watermark."""
    root = files.landing_dir(spark)
    sections = t("lineitem").select(line_id().alias("section_id"), F.col("l_orderkey").alias("citation"), F.col("l_shipdate").cast("timestamp").alias("at"))
    actions = t("orders").select(F.col("o_orderkey").alias("action_id"), F.col("o_orderkey").alias("citation"), F.col("o_orderdate").cast("timestamp").alias("published"))
    sections.write.parquet(f"{root}/sections")
    for late in (False, True):
        actions.where((F.xxhash64("action_id") % 2 == 0) == F.lit(late)).write.mode("append").parquet(f"{root}/actions")
        streams = [spark.readStream.schema(df.schema).parquet(f"{root}/{name}") for name, df in (("sections", sections), ("actions", actions))]
        V.take(V.stitched(*streams, late="4000 days", after=STITCH_DAYS), f"{root}/links", f"{root}/cursor", timers=False)
    links = spark.read.parquet(f"{root}/links").select("section_id", "action_id")
    return sections.select("section_id").join(links, "section_id", "left")


#: Documents as raw records of seven sources and one that has no normaliser, by their source's number. Short ones lack their key, have no such agency or a day that is none.
SYSTEMS = ("cfr", "iac", "federal_register", "iurc_rulemakings", "idem_rulemakings", "iurc_gaos", "iurc_investigations", "broken", "cfr")
LANDED = f"""d as (select case cast(substring(source, 4) as int) % 9 {' '.join(f"when {i} then '{s}'" for i, s in enumerate(SYSTEMS))} end as s, n_chars >= 200 as ok, cast(doc_id as varchar) as k, lang from documents),
r as (select s as source_system, null as error, case s when 'cfr' then '18 CFR ' || lang || '.' || k when 'iac' then '170 IAC ' || k else k end as key,
case s when 'federal_register' then case when lang = 'en' then 'interim_final_rule' else 'final_rule' end when 'iurc_rulemakings' then 'proposed_rule' when 'idem_rulemakings' then 'rulemaking' when 'iurc_gaos' then 'order' when 'iurc_investigations' then case when lang = 'fr' then 'commission_investigation' else 'order' end end as action_type,
case when s = 'iac' then 'repealed' when s in ('cfr', 'federal_register', 'iurc_gaos') then 'approved' else 'in_progress' end as status from d where s <> 'broken' and ok
union all select s, case when s = 'cfr' then 'ValueError' else 'KeyError' end, null, null, null from d where not ok and s in ('cfr', 'iac'))"""


def raw_pages(t, spark) -> str:
    """The folder of the landed documents."""
    number = F.expr("cast(substring(source, 4) as int) % 9")
    doc, day, first = F.col("doc_id").cast("string"), F.lit("2024-05-06"), F.substring("text", 1, 60)
    ok = F.col("n_chars") >= 200
    of = {
        "cfr": {"title_number": F.lit(18), "part": F.col("lang"), "section_number": doc, "heading": first, "body_text": F.col("text"), "amendment_date": F.when(ok, day).otherwise("soon")},
        "iac": {"citation": F.when(ok, F.concat(F.lit("170 IAC "), doc)), "heading": F.lit("x (Repealed)"), "snapshot_date": day},
        "federal_register": {"document_number": doc, "title": first, "type": F.lit("Rule"), "action": F.when(F.col("lang") == "en", "Interim final rule."), "publication_date": day, "agencies": F.array(F.struct(F.when(ok, "environmental-protection-agency").otherwise("other").alias("slug")))},
        "iurc_rulemakings": {"rm_number": F.when(ok, doc), "lsa_number": F.concat(F.lit("24 "), doc), "date_published": day},
        "idem_rulemakings": {"lsa_id": F.when(ok, doc), "rule_heading": first, "pdf_type": F.lit("final_rule")},
        "iurc_gaos": {"gao_id": F.when(ok, doc), "title": first},
        "iurc_investigations": {"cause_number": F.when(ok, doc), "date_filed": F.lit("5/6/2024"), "is_investigation": F.col("lang") == "fr"},
    }
    raw = F.coalesce(*[F.when(F.col("source_system") == s, F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))) for s, fields in of.items()], F.lit("{}"))
    path = files.landing_dir(spark)
    docs = t("documents").withColumn("source_system", F.get(F.array(*[F.lit(x) for x in SYSTEMS]), number)).select("source_system", raw.alias("value"))
    docs.write.option("maxRecordsPerFile", 2000).partitionBy("source_system").text(path)
    return path


def told_error():
    return F.coalesce(F.nullif(F.regexp_extract("error", r"^(\w+Error):", 1), F.lit("")), F.col("error"))


@query("A11_landed_records", f"with {LANDED} select *, count(*) as n from r group by all union all select 'broken', 'no normaliser for broken', null, null, null, 1")
def landed_records(t, spark):
    """Every source's records as canonical rows, by the data source; what is wrong is a row of its own and stops nothing else. A source without normaliser has a row a page."""
    landed.register(spark)
    rows = spark.read.format("landed_pages").load(raw_pages(t, spark))
    n = F.when(F.first(F.col("page").isNotNull() & F.col("position").isNull()), F.lit(1).cast("long")).otherwise(F.count("*"))
    return rows.groupBy("source_system", told_error().alias("error"), "key", "action_type", "status").agg(n.alias("n"))


@query("A12_isolated_stream", f"with {LANDED} select source_system, case when source_system = 'iac' then 0 else count(*) end as n_while_down, count(*) as n, count(error) as n_errors from r group by 1")
def isolated_stream(t, spark):
    """Taken twice by a stream from its cursor: first while one source is down, then when it is well; the others are taken once."""
    landed.register(spark)
    path, out = raw_pages(t, spark), files.landing_dir(spark)
    landed.mark_down(spark, f"{path}/source_system=iac")
    for name in ("n_while_down", "n"):
        stream = spark.readStream.format("landed_pages").load(path).where("position is not null").select("source_system", "error")
        V.take(stream, f"{out}/rows", f"{out}/cursor")
        got = spark.read.parquet(f"{out}/rows").groupBy("source_system").agg(F.count("*").alias(name), F.count("error").alias("n_errors"))
        if name == "n_while_down":
            got.drop("n_errors").write.parquet(f"{out}/first")
            landed.mark_well(spark, f"{path}/source_system=iac")
    first = spark.read.parquet(f"{out}/first")
    return got.join(first, "source_system", "left").select("source_system", F.coalesce("n_while_down", F.lit(0)).alias("n_while_down"), "n", "n_errors")


def as_markdown(docs):
    """Documents as Markdown (doc_id ACM-DOC-<n>): of their sentences, by length, some are headings, some follow a clause's marker, some are rows of a table or stand in a fence."""
    key = F.col("key")
    sentences = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), r"(?<=[.!?]) ")

    def line(s, i):
        n, m = F.length(s), (F.length(s) % 11)
        local = F.when(n % 4 == 0, F.concat((n % 9).cast("string"), F.lit("."), (i % 5).cast("string"))).otherwise((n % 9).cast("string"))
        table = F.concat(F.lit("<!-- table: "), key, F.lit(":T"), (n % 3).cast("string"), F.lit(" -->\n\n| ID | Words |\n|---|---|\n| "), i.cast("string"), F.lit(" | "), s, F.lit(" |\n| "), (n % 7).cast("string"), F.lit(" | again |"))
        return (
            F.when(m < 2, F.concat(F.repeat(F.lit("#"), (n % 3 + 1).cast("int")), F.lit(" "), F.substring(s, 1, 30)))
            .when(m < 5, F.concat(F.lit("<!-- clause: "), key, F.lit(":"), local, F.lit(" -->\n"), s))
            .when(m == 5, table)
            .when(m == 6, F.concat(F.lit("```\n"), s, F.when(n % 5 > 0, F.lit("\n```")).otherwise("")))
            .otherwise(s)
        )

    named = docs.select(F.concat(F.lit("ACM-DOC-"), F.col("doc_id").cast("string")).alias("key"), "text")
    return named.select(key.alias("doc_id"), F.array_join(F.transform(sentences, line), "\n").alias("text"))


@query("E15_segments")
def segments(t, spark):
    """The clauses and table rows of all documents, by one scan of each document's lines."""
    return markdown.segments(as_markdown(t("documents")))


@query("L9_word_windows", """with u as (select conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from conversations), f as (select conv_id, turn, unnest(w) as word, generate_subscripts(w, 1) as j from u),
p as (select *, row_number() over (partition by conv_id order by turn, j) - 1 as pos, count(*) over (partition by conv_id) as n from f), c as (select conv_id, n, unnest(generate_series(0, cast(greatest(ceil((n - 50) / 40), 0) as bigint))) as chunk from (select distinct conv_id, n from p))
select c.conv_id, cast(chunk as int) as chunk, min(turn) as first_turn, cast(count(*) as int) as n_words, sha256(string_agg(word, ' ' order by pos)) as digest from c join p on p.conv_id = c.conv_id and pos >= chunk * 40 and pos < chunk * 40 + 50 group by 1, 2""")
def word_windows(t, spark):
    """A table function over a partitioned table: windows of words that run on from one turn to the next."""
    tables.register(spark)
    found = spark.sql("select * from word_windows(table({t}), size => 50, overlap => 10)", t=t("conversations").select("conv_id", "turn", "text"))
    return found.select("conv_id", "chunk", "first_turn", "n_words", F.sha2("words", 256).alias("digest"))


@query("A18_sniffed_files", "select 'obl' as kind, 'row_id' as key_column, true as is_register, count(distinct p_size % 3) as n from part where p_size % 3 = 0 union all select 'other', 'row_id', false, 1 union all select 'plain', 'p_partkey', false, 1")
def sniffed_files(t, spark):
    """Registers among CSV files, by their header and first row."""
    path = files.landing_dir(spark)
    p = t("part")
    key = F.concat(F.lit("OBL-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("-1"))
    for kind, df in {"obl": p.select(key.alias("row_id"), "p_name"), "other": p.select(F.col("p_name").alias("row_id"), "p_size"), "plain": p.select("p_partkey", key.alias("row_id"))}.items():
        df.coalesce(1).write.csv(f"{path}/{kind}", header=True, quoteAll=kind == "other")
    found = files.sniff_registers(spark, path)
    return found.groupBy(F.regexp_extract("path", r"/(obl|other|plain)/", 1).alias("kind"), "key_column", "is_register").agg(F.count("*").alias("n"))


@query("K3_streamed_once", "select event_id, event_type from events")
def streamed_once(t, spark):
    """Immutable events that land twice, the second time with half of them again: each is taken once."""
    root = files.landing_dir(spark)
    e = t("events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for part in ("event_id % 3 > 0", "event_id % 2 = 0 or event_id % 3 = 0"):
        e.where(part).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(e.schema).parquet(f"{root}/landing")
        V.take(S.distinct_events(stream, "event_id", "ts", "400 days"), f"{root}/taken", f"{root}/cursor")
    return spark.read.parquet(f"{root}/taken").select("event_id", "event_type")


@query("L4_validated_checks", """with m as (select max(l_quantity) as q, max(l_discount) as d, max(l_tax) as t from lineitem) select 'quantity' as name, 'valid' as status, 0 as n from m union all select 'discount', 'invalid', count_if(l_discount > 0.05) from lineitem union all select 'tax', 'unbound', null union all select 'drop', 'refused', null union all select 'broken', 'error', null
union all select 'window', case when count_if(l_quantity > m.q or l_discount > m.d) = 0 then 'valid' else 'invalid' end, count_if(l_quantity > m.q or l_discount > m.d) from lineitem, m""")
def validated_checks(t, spark):
    """Proposed checks with the values of a document, held against data that is known to be right."""
    l = t("lineitem")
    stated = l.agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d")).select(F.explode(F.array(F.struct(F.lit("largest quantity").alias("name"), F.col("q").alias("value")), F.struct(F.lit("largest discount").alias("name"), F.col("d").alias("value")), F.struct(F.lit("usual discount").alias("name"), F.lit(0.05).alias("value")))).alias("v")).select("v.*")
    proposed = [
        {"name": "quantity", "sql": "select * from {lines} where l_quantity > :most", "bindings": {"most": "largest quantity"}},
        {"name": "discount", "sql": "select * from {lines} where l_discount > :most", "bindings": {"most": "usual discount"}},
        {"name": "tax", "sql": "select * from {lines} where l_tax > :most", "bindings": {"most": "largest tax"}},
        {"name": "drop", "sql": "drop table lines", "bindings": {}},
        {"name": "broken", "sql": "select nothing from {lines}", "bindings": {}},
        {"name": "window", "sql": "select * from {lines} where l_quantity > :a or l_discount > :b", "bindings": {"a": "largest quantity", "b": "largest discount"}},
    ]
    found = profiling.validate_checks(spark, proposed, stated, lines=l)
    return spark.createDataFrame([(r["name"], r["status"], r["n"]) for r in found], "name string, status string, n long")


@query("A19_loaded_references", """select 'person' as kind, cast(c_custkey as varchar) as key, array_to_string(list_filter(['role ' || c_nationkey % 3, case when c_custkey % 2 = 0 then 'lead' end, case when c_custkey % 5 = 0 then 'deputy' end], lambda x: x is not null), '|') as value, null as num, null as flag from customer
union all select 'attribute', 'n_' || n_nationkey, case n_nationkey % 4 when 0 then 'True' when 1 then cast(n_nationkey * 10 as varchar) when 2 then n_name else '12' end, case n_nationkey % 4 when 1 then n_nationkey * 10.0 when 3 then 12.0 end, case when n_nationkey % 4 = 0 then true end from nation""")
def loaded_references(t, spark):
    """People with lists in their cells, and attributes of a profile as truth values, numbers or text."""
    path = files.landing_dir(spark)
    roles = F.concat(F.lit(" role "), (F.col("c_nationkey") % 3).cast("string"), F.lit(" ;"), F.when(F.col("c_custkey") % 2 == 0, "lead").otherwise(" "), F.lit(";; "), F.when(F.col("c_custkey") % 5 == 0, "deputy ").otherwise(""))
    t("customer").select("c_custkey", "c_name", roles.alias("roles")).write.csv(f"{path}/people", header=True)
    value = F.when(F.col("n_nationkey") % 4 == 0, "yes  # as stated").when(F.col("n_nationkey") % 4 == 1, (F.col("n_nationkey") * 10).cast("string")).when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit("'"), "n_name", F.lit("'"))).otherwise('"12"')
    lines = t("nation").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  n_"), F.col("n_nationkey").cast("string"), F.lit(": "), value))), "\n").alias("body"))
    lines.select(F.concat(F.lit("name: Somebody\napplicability_attributes:\n"), "body", F.lit("\nother:\n  key: 1\n")).alias("value")).write.text(f"{path}/profile")
    people = files.read_people(spark, f"{path}/people").select(F.lit("person").alias("kind"), F.col("c_custkey").alias("key"), F.array_join("roles", "|").alias("value"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("flag"))
    attributes = files.read_attributes(spark, f"{path}/profile").select(F.lit("attribute").alias("kind"), "key", F.col("value_text").alias("value"), F.col("value_num").alias("num"), F.col("value_bool").alias("flag"))
    return people.unionByName(attributes)


@query("A29_report", "select (select count(*) from orders) as n_orders, (select count(*) from lineitem) as n_lines, (select count(distinct o_orderpriority) from orders where o_orderstatus = 'P') as n_codes, (select count(*) from orders where o_orderstatus = 'P') as n_issues, 2 as n_checks, (select count_if(l_quantity > 49) = 0 from lineitem) as passed")
def report(t, spark):
    """A run's counts, issues and checks as one JSON document, read back."""
    path = files.landing_dir(spark)
    o, l = t("orders"), t("lineitem")
    stats = o.agg(F.lit("orders").alias("name"), F.count("*").alias("n")).unionByName(l.agg(F.lit("lines").alias("name"), F.count("*").alias("n")))
    issues = o.where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("code"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("message"))
    found = profiling.assert_empty("quantity", l.where("l_quantity > 49")).unionByName(profiling.assert_empty("key", o.where("o_orderkey is null")))
    files.write_report(stats, issues, found, path)
    r = spark.read.schema("stats map<string,long>, issues array<struct<code:string,n:long,first:string>>, checks array<struct<check_name:string,n_violations:long,passed:boolean>>, passed boolean").json(path)
    return r.select(F.col("stats")["orders"].alias("n_orders"), F.col("stats")["lines"].alias("n_lines"), F.size("issues").cast("long").alias("n_codes"), F.aggregate("issues", F.lit(0).cast("long"), lambda a, i: a + i["n"]).alias("n_issues"), F.size("checks").alias("n_checks"), "passed")


NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
CELL_CITED = "case p_size % 5 when 0 then format('{} IAC {}-1-{}', p_size, p_partkey % 9 + 1, p_partkey % 40 + 1) when 1 then format('{} CFR {}.{}', p_size, p_partkey % 90 + 1, p_partkey % 40 + 1) when 2 then format('IC {}-1-{}', p_partkey % 9 + 1, p_partkey % 40 + 1) end"


@query("B24_new_citations", f"select p_partkey as clause_id, c as citation from (select p_partkey, p_size, {CELL_CITED} as c from part) where c is not null and p_partkey % 7 <> 0 union all select p_partkey, '16 USC 824' from part where p_size % 4 = 0 and p_partkey % 7 <> 0")
def new_citations(t, spark):
    """Citations in any cell of a register, by a key of clause, column and citation; those that are stored already are left out."""
    n, m = F.col("p_partkey") % 9 + 1, F.col("p_partkey") % 40 + 1
    cited = F.when(F.col("p_size") % 5 == 0, F.format_string("see %d IAC %d-1-%d, and note", "p_size", n, m)).when(F.col("p_size") % 5 == 1, F.format_string("%d C.F.R. § %d.%d", "p_size", F.col("p_partkey") % 90 + 1, m)).when(F.col("p_size") % 5 == 2, F.format_string("(IC %d-1-%d)", n, m)).otherwise(F.col("p_name"))
    cells = F.create_map(F.lit("basis"), cited, F.lit("other"), F.when(F.col("p_size") % 4 == 0, "16 U.S.C. 824").otherwise(" "), F.lit("note"), F.lit(None).cast("string"))
    units = t("part").select(F.col("p_partkey").alias("clause_id"), cells.alias("row_cells"))
    stored = clause_citations(units).where("clause_id % 7 = 0").select("citation_id")
    return clause_citations(units).join(stored, "citation_id", "left_anti").select("clause_id", "citation")


def clause_citations(units):
    """(citation_id, clause_id, column, citation) of all cells that hold text."""
    cells = units.select("clause_id", F.explode("row_cells").alias("column", "cell")).where("trim(cell) <> ''")
    found = spread(cells).select("clause_id", "column", F.explode(G.citations("cell")).alias("c")).select("clause_id", "column", F.col("c.citation").alias("citation")).distinct()
    return found.withColumn("citation_id", files.uuid5(NAMESPACE, F.concat_ws("|", F.col("clause_id").cast("string"), "column", "citation")))
