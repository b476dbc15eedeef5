"""Aggregates, profiles, assertions and retrieval over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import inclusion, profiling, retrieval
from tessera.registry import query


@query("D1_span_of_snapshots", "select o_custkey, min(o_orderdate) as s1, max(o_orderdate) as s2 from orders group by o_custkey having min(o_orderdate) <> max(o_orderdate)")
def span_of_snapshots(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("s1"), F.max("o_orderdate").alias("s2")).where("s1 <> s2")


@query("D2_class_counts", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by 1, 2")
def class_counts(t, spark):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("D3_funnel", "select count(*) as n_all, count_if(o_orderstatus = 'F') as n_done, count_if(o_orderstatus = 'F' and o_totalprice > 100000) as n_large, count(distinct o_custkey) as n_customers from orders")
def funnel(t, spark):
    done = F.col("o_orderstatus") == "F"
    return t("orders").agg(F.count("*").alias("n_all"), F.count_if(done).alias("n_done"), F.count_if(done & (F.col("o_totalprice") > 100000)).alias("n_large"), F.countDistinct("o_custkey").alias("n_customers"))


@query("D4_distinct_per_key", "select l_partkey, count(distinct l_orderkey) as n from lineitem group by l_partkey")
def distinct_per_key(t, spark):
    return t("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n"))


@query("D5_union_count", "select k, count(distinct o) as n from (select l_partkey % 100 as k, l_orderkey as o from lineitem union all select l_suppkey, l_orderkey from lineitem) group by k")
def union_count(t, spark):
    l = t("lineitem")
    both = l.select((F.col("l_partkey") % 100).alias("k"), F.col("l_orderkey").alias("o")).unionByName(l.select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("o")))
    return both.groupBy("k").agg(F.countDistinct("o").alias("n"))


@query("D6_document_rollup", """with c as (select o_custkey, o_orderkey, bool_or(l_returnflag = 'R') as f, bool_or(l_returnflag = 'A') as r, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by 1, 2)
select o_custkey, count(*) as n_changes, count_if(f) as n_flagged, count_if(not f and r) as n_review, cast(sum(n) as bigint) as n_lines, case when bool_or(f) then 'flagged' when bool_or(r) then 'review' else 'clear' end as status from c group by o_custkey""")
def document_rollup(t, spark):
    l = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    per = l.groupBy("o_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("f"), F.bool_or(F.col("l_returnflag") == "A").alias("r"), F.count("*").alias("n"))
    status = F.when(F.bool_or("f"), "flagged").when(F.bool_or("r"), "review").otherwise("clear")
    return t("orders").select("o_orderkey", "o_custkey").join(per, "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("n_changes"), F.count_if("f").alias("n_flagged"), F.count_if(~F.col("f") & F.col("r")).alias("n_review"), F.sum("n").alias("n_lines"), status.alias("status"))


@query("D7_reason_text", """select c_nationkey, string_agg(c_mktsegment || ' ' || n, ', ' order by n desc, c_mktsegment) as reason from (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2) group by 1""")
def reason_text(t, spark):
    n = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "c_mktsegment")))
    return n.groupBy("c_nationkey").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["c_mktsegment"], F.lit(" "), (-x["m"]).cast("string"))), ", ").alias("reason"))


@query("D8_disposition", "select o_orderkey, case when n = 0 then 'no_candidates' when r > 0 then 'findings' else 'cleared' end as disposition from (select o_orderkey, count(l_orderkey) n, count_if(l_returnflag = 'R') r from orders left join lineitem on l_orderkey = o_orderkey group by 1)")
def disposition(t, spark):
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return t("orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.when(F.col("r").isNull(), "no_candidates").when(F.col("r") > 0, "findings").otherwise("cleared").alias("disposition"))


@query("D9_directory", "select n_name, count(distinct c_custkey) as n_customers, count(distinct c_mktsegment) as n_segments, min(c_acctbal) as low, max(c_acctbal) as high, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as segments from nation join customer on c_nationkey = n_nationkey group by n_name")
def directory(t, spark):
    c = t("customer").groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("n_customers"), F.countDistinct("c_mktsegment").alias("n_segments"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"))
    return c.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n_customers", "n_segments", "low", "high", "segments")


@query("D10_worst_cell", "select l_suppkey, date_trunc('month', l_shipdate) as month, count(*) as n, min(case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end) as worst from lineitem group by 1, 2")
def worst_cell(t, spark):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return t("lineitem").groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), F.min(rank).alias("worst"))


@query("D12_nested_histogram", "select cast(json_extract(props, '$.k') as integer) // 10 as bucket, count(*) as n from events group by 1")
def nested_histogram(t, spark):
    return t("events").select(F.floor(F.from_json("props", "k int")["k"] / 10).cast("int").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("D13_profile", """select * from (select 'c_mktsegment' as column_name, count(*) as n_rows, count_if(c_mktsegment is null) as n_null, count(distinct c_mktsegment) as n_distinct, min(c_mktsegment) as min_value, max(c_mktsegment) as max_value from customer
union all select 'c_name', count(*), count_if(c_name is null), count(distinct c_name), min(c_name), max(c_name) from customer union all select 'c_nationkey', count(*), count_if(c_nationkey is null), count(distinct c_nationkey), min(cast(c_nationkey as varchar)), max(cast(c_nationkey as varchar)) from customer)""")
def profile(t, spark):
    return profiling.profile(t("customer"), ["c_mktsegment", "c_name", "c_nationkey"])


@query("D13_top_values", "select 'c_mktsegment' as column_name, c_mktsegment as value, count(*) as n, cast(row_number() over (order by count(*) desc, c_mktsegment) as integer) as rank from customer group by c_mktsegment qualify rank <= 10")
def top_values(t, spark):
    return profiling.top_values(t("customer"), ["c_mktsegment", "c_name"])


def key_sql(table: str, columns: tuple[str, ...]) -> str:
    """The first of these columns that has as many values as the table has rows."""
    tests = " ".join(f"when count(distinct {c}) = count(*) and count(*) > 0 then '{c}'" for c in columns)
    return f"select '{table}' as table_name, {f'case {tests} end' if columns else 'cast(null as varchar)'} as key_name from {table}"


#: The columns of every table that are named like keys.
KEYED = {"region": ("r_regionkey",), "nation": ("n_nationkey", "n_regionkey"), "customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey"), "part": ("p_partkey",), "orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"), "events": ("event_id", "user_id"), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id",)}


@query("D14_primary_keys", " union all ".join(key_sql(n, c) for n, c in KEYED.items()))
def primary_keys(t, spark):
    """Every table's key, if it has one."""
    return inclusion.primary_keys({n: t(n) for n in KEYED})


#: Every table, and its columns that hold lists and so no plain values.
PLAIN = {name: "" for name in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()} | {"embeddings": "exclude (embedding)"}
INVERTED = f"""v as (select distinct t || '.' || name as col, value as v from ({" union all ".join(f"select '{n}' as t, name, value from (unpivot (select columns(*)::varchar from (select * {x} from {n})) on columns(*) into name name value value)" for n, x in PLAIN.items())})),
n as (select col, count(*) as n from v group by 1), m as (select a.col as child, b.col as parent, count(*) as n_matched from v a join v b on a.v = b.v where split_part(a.col, '.', 1) <> split_part(b.col, '.', 1) group by 1, 2)"""


@query("C34_inclusions", f"with {INVERTED} select child, parent, n as n_values, n_matched, round(n_matched / n, 6) as ratio from m join n on col = child where n_matched >= 0.9 * n")
def inclusions(t, spark):
    """All pairs of columns of different tables of which one holds nine tenths or more of the other's values."""
    return inclusion.inclusions({name: t(name) for name in PLAIN}).select("child", "parent", "n_values", "n_matched", "ratio")


@query("C34_foreign_keys", "select * from (select 'orders.o_custkey' as child, 'customer.c_custkey' as parent, (select count(*) from (select distinct o_custkey k from orders) join customer on c_custkey = k) / (select count(distinct o_custkey) from orders) as r union all select 'lineitem.l_partkey', 'part.p_partkey', (select count(*) from (select distinct l_partkey k from lineitem) join part on p_partkey = k) / (select count(distinct l_partkey) from lineitem) union all select 'lineitem.l_suppkey', 'supplier.s_suppkey', (select count(*) from (select distinct l_suppkey k from lineitem) join supplier on s_suppkey = k) / (select count(distinct l_suppkey) from lineitem) union all select 'lineitem.l_orderkey', 'orders.o_orderkey', (select count(*) from (select distinct l_orderkey k from lineitem) join orders on o_orderkey = k) / (select count(distinct l_orderkey) from lineitem) union all select 'customer.c_nationkey', 'nation.n_nationkey', (select count(*) from (select distinct c_nationkey k from customer) join nation on n_nationkey = k) / (select count(distinct c_nationkey) from customer) union all select 'supplier.s_nationkey', 'nation.n_nationkey', (select count(*) from (select distinct s_nationkey k from supplier) join nation on n_nationkey = k) / (select count(distinct s_nationkey) from supplier) union all select 'nation.n_regionkey', 'region.r_regionkey', (select count(*) from (select distinct n_regionkey k from nation) join region on r_regionkey = k) / (select count(distinct n_regionkey) from nation)) where r >= 0.9")
def foreign_keys(t, spark):
    """Of the inclusions those in a unique key that the column is named after."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    return inclusion.foreign_keys(inclusion.inclusions({n: t(n) for n in names})).select("child", "parent", F.col("ratio").alias("r"))


@query("C35_clause_columns", rf"""with ids as (select distinct l_suppkey as doc_id, cast(l_partkey as varchar) as id from lineitem), v as (select distinct name as col, value as v from (unpivot (select columns(*)::varchar from orders) on columns(*) into name name value value)),
s as (select col, count(*) as n, count_if(regexp_full_match(v, '(\d+(\.\d+){{0,2}}[a-z]?|App-[A-Z]\.\d+|S\d+\.\d+)')) as k from v group by 1), h as (select col, doc_id, count(*) as m from v join ids on v = id group by 1, 2)
select 'orders.' || col as col, doc_id, round(k / n, 6) as shaped, round(m / n, 6) as known from s join h using (col) where k >= 0.9 * n and m >= 0.05 * n""")
def clause_columns(t, spark):
    """Columns of orders shaped like clause ids, with the suppliers (as documents) whose parts (as clauses) are a twentieth of their values or more."""
    ids = t("lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("local_id"))
    return inclusion.reference_columns("orders", t("orders"), ids, known=0.05)


@query("C34_fk_discovery", """select * from (select 'o_custkey' as child, 'c_custkey' as parent, count(*) as n_values, count(c_custkey) as n_matched, round(count(c_custkey) / count(*), 6) as ratio from (select distinct o_custkey k from orders) left join customer on k = c_custkey
union all select 'l_partkey', 'p_partkey', count(*), count(p_partkey), round(count(p_partkey) / count(*), 6) from (select distinct l_partkey k from lineitem) left join part on k = p_partkey
union all select 'l_suppkey', 's_suppkey', count(*), count(s_suppkey), round(count(s_suppkey) / count(*), 6) from (select distinct l_suppkey k from lineitem) left join supplier on k = s_suppkey)""")
def fk_discovery(t, spark):
    out = None
    for child, c, parent, p in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")):
        row = profiling.containment(t(child), c, t(parent), p).select(F.lit(c).alias("child"), F.lit(p).alias("parent"), "n_values", "n_matched", "ratio")
        out = row if out is None else out.unionByName(row)
    return out


@query("D16_precision_recall", "select count_if(quality = 1 and toxic = 0) as tp, round(count_if(quality = 1 and toxic = 0) / count_if(quality = 1), 6) as precision_, round(count_if(quality = 1 and toxic = 0) / count_if(toxic = 0), 6) as recall from labels")
def precision_recall(t, spark):
    tp = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0))
    return t("labels").agg(tp.alias("tp"), F.round(tp / F.count_if(F.col("quality") == 1), 6).alias("precision_"), F.round(tp / F.count_if(F.col("toxic") == 0), 6).alias("recall"))


@query("D17_kappa", """with c as (select count(*) n, count_if(quality = toxic) a, count_if(quality = 1) q, count_if(toxic = 1) x from labels), e as (select a / n as po, (q * x + (n - q) * (n - x)) / (n * n) as pe from c) select round((po - pe) / (1 - pe), 6) as kappa from e""")
def kappa(t, spark):
    c = t("labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("a"), F.count_if(F.col("quality") == 1).alias("q"), F.count_if(F.col("toxic") == 1).alias("x"))
    e = c.select((F.col("a") / F.col("n")).alias("po"), ((F.col("q") * F.col("x") + (F.col("n") - F.col("q")) * (F.col("n") - F.col("x"))) / (F.col("n") * F.col("n"))).alias("pe"))
    return e.select(F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6).alias("kappa"))


@query("D19_confusion", "select quality, count_if(toxic = 0) as toxic_0, count_if(toxic = 1) as toxic_1 from labels group by quality")
def confusion(t, spark):
    return t("labels").groupBy("quality").pivot("toxic", [0, 1]).count().na.fill(0).withColumnsRenamed({"0": "toxic_0", "1": "toxic_1"})


@query("D20_interval_overlap", """select count(*) as n_found from (select distinct a.o_orderkey from orders a where exists (select 1 from orders b where b.o_custkey = a.o_custkey and b.o_orderkey <> a.o_orderkey and b.o_orderdate <= a.o_orderdate + interval 30 day and a.o_orderdate <= b.o_orderdate + interval 30 day))""")
def interval_overlap(t, spark):
    a = t("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    b = a.select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"))
    near = (F.col("k") != F.col("o_orderkey")) & (F.abs(F.datediff("d", "o_orderdate")) <= 30)
    return a.join(b, (a["o_custkey"] == b["o_custkey"]) & near, "left_semi").agg(F.count("*").alias("n_found"))


@query("D23_reliability", """select year, month, cast(sum(n) as bigint) as n, cast(sum(u) as bigint) as u from (select extract(year from o_orderdate) as year, extract(month from o_orderdate) as month, 1 as n, case when o_orderstatus = 'F' then 1 else 0 end as u from orders) group by grouping sets ((year, month), (year))""")
def reliability(t, spark):
    """Months and years in one pass."""
    o = t("orders").select(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("u"))
    return o.rollup("year", "month").agg(F.count("*").alias("n"), F.sum("u").alias("u")).where("year is not null")


@query("D24_tmed", "select round(exp(avg(ln(v)) + 2.5 * stddev_samp(ln(v))), 4) as tmed from (select cast(ts as date) d, sum(value) v from events group by 1) where v > 0")
def tmed(t, spark):
    daily = t("events").groupBy(F.to_date("ts").alias("d")).agg(F.sum("value").alias("v")).where("v > 0")
    return daily.agg(F.round(F.exp(F.avg(F.ln("v")) + 2.5 * F.stddev_samp(F.ln("v"))), 4).alias("tmed"))


@query("D25_event_days", """with d as (select cast(ts as date) as day, sum(value) v from events group by 1), m as (select avg(v) + stddev_samp(v) as t from d) select day, v > t as is_event_day from d, m""")
def event_days(t, spark):
    d = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    m = d.agg((F.avg("v") + F.stddev_samp("v")).alias("t"))
    return d.join(F.broadcast(m)).select("day", (F.col("v") > F.col("t")).alias("is_event_day"))


@query("D26_incident_rollup", """select user_id, bool_or(event_type = 'error') as any_error, bool_and(value > 0) as all_positive, min(ts) as first, max(ts) as last, max(value) as top, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by user_id""")
def incident_rollup(t, spark):
    return t("events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("any_error"), F.bool_and(F.col("value") > 0).alias("all_positive"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("value").alias("top"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("D26_mode", "select user_id, arg_max(event_type, (n, -f)) as common from (select user_id, event_type, count(*) n, min(event_id) f from events group by 1, 2) group by user_id")
def mode_first(t, spark):
    """The most frequent value, the first seen of ties."""
    n = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return n.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("f"))).alias("common"))


@query("D27_three_keys", "select date_trunc('month', ts) as month, event_type, value > 50 as large, count(*) as n from events group by 1, 2, 3")
def three_keys(t, spark):
    return t("events").groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), "event_type", (F.col("value") > 50).alias("large")).agg(F.count("*").alias("n"))


@query("D28_sum_reconciliation", "select o_orderkey from orders join (select l_orderkey, sum(l_quantity) q, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey where q > 30 * n")
def sum_reconciliation(t, spark):
    l = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return t("orders").select("o_orderkey").join(l, "o_orderkey").where("q > 30 * n").select("o_orderkey")


@query("D29_heavy_tail", "with r as (select o_totalprice p, row_number() over (order by o_totalprice desc, o_orderkey) i, count(*) over () n from orders) select round(sum(p) filter (where i <= greatest(1, floor(0.01 * n))) / sum(p), 8) as share from r")
def heavy_tail(t, spark):
    """The top hundredth's share: the count first, then a top-k; no window over all rows."""
    o = t("orders").select("o_totalprice", "o_orderkey")
    n = o.count()
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(max(1, n // 100)).agg(F.sum("o_totalprice").alias("t"))
    return o.agg(F.sum("o_totalprice").alias("a")).join(F.broadcast(top)).select(F.round(F.col("t") / F.col("a"), 8).alias("share"))


@query("D30_weighted_totals", "select p_type, round(sum(p_retailprice / d), 4) as total from part join (values ('ECONOMY', 2.0), ('STANDARD', 3.0), ('PROMO', 4.0), ('LARGE', 5.0), ('MEDIUM', 6.0), ('SMALL', 7.0)) x(k, d) on k = p_type group by p_type")
def weighted_totals(t, spark):
    d = F.create_map(*[F.lit(x) for kv in (("ECONOMY", 2.0), ("STANDARD", 3.0), ("PROMO", 4.0), ("LARGE", 5.0), ("MEDIUM", 6.0), ("SMALL", 7.0)) for x in kv])
    return t("part").withColumn("d", d[F.col("p_type")]).where("d is not null").groupBy("p_type").agg(F.round(F.sum(F.col("p_retailprice") / F.col("d")), 4).alias("total"))


@query("D33_acceptance", """select 'orders_have_customers' as check_name, count(*) as n_violations, count(*) = 0 as passed from orders where o_custkey not in (select c_custkey from customer)
union all select 'unique_orders', count(*), count(*) = 0 from (select o_orderkey from orders group by 1 having count(*) > 1) union all select 'discount_range', count(*), count(*) = 0 from lineitem where l_discount not between 0 and 0.1""")
def acceptance(t, spark):
    o = t("orders")
    a = profiling.assert_empty("orders_have_customers", o.join(t("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti"))
    b = profiling.assert_empty("unique_orders", o.groupBy("o_orderkey").count().where("count > 1"))
    return a.unionByName(b).unionByName(profiling.assert_empty("discount_range", t("lineitem").where("l_discount not between 0 and 0.1")))


@query("D34_progress", "select (select count(*) from orders) as n_orders, (select count_if(l_returnflag = 'R') from lineitem) as n_returned, (select count(*) from customer where c_acctbal < 0) as n_negative")
def progress(t, spark):
    a = t("orders").agg(F.count("*").alias("n_orders"))
    b = t("lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    return a.join(F.broadcast(b)).join(F.broadcast(t("customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("n_negative"))))


@query("D36_collected", "select l_orderkey, string_agg(cast(l_partkey as varchar), ',' order by l_partkey) as parts from lineitem group by 1")
def collected(t, spark):
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("parts"))


@query("D38_hierarchical_counts", "select r_name, n_name, c_mktsegment, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name, c_mktsegment)")
def hierarchical_counts(t, spark):
    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("D40_largest_remainder", """with s as (select c_nationkey k, count(*) n from customer group by 1), x as (select k, 1000.0 * n / sum(n) over () as e from s), f as (select k, e, floor(e) b, row_number() over (order by e - floor(e) desc, k) r, 1000 - sum(floor(e)) over () d from x)
select k, cast(b + case when r <= d then 1 else 0 end as bigint) as seats from f""")
def largest_remainder(t, spark):
    """Seats that add up to 1000; the groups are few, so one sorted window over their counts is bounded."""
    s = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    x = s.withColumn("e", F.lit(1000.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))
    f = x.withColumn("b", F.floor("e")).withColumn("r", F.row_number().over(Window.orderBy((F.col("e") - F.floor("e")).desc(), "k")))
    return f.select("k", (F.col("b") + F.when(F.col("r") <= 1000 - F.sum("b").over(Window.partitionBy()), 1).otherwise(0)).alias("seats"))


@query("D41_stratified_sample", """with n as (select c_nationkey g, count(*) c from customer group by 1), b as (select g, case when c <= 50 then 3 when c <= 100 then 5 else 8 end as k from n)
select c_custkey from (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by md5('seed' || cast(c_custkey as varchar))) r from customer) join b on g = c_nationkey where r <= k""")
def stratified_sample(t, spark):
    """Sample sizes by a band of the group's size; rows by a seeded hash."""
    w = Window.partitionBy("c_nationkey")
    k = F.when(F.count("*").over(w) <= 50, 3).when(F.count("*").over(w) <= 100, 5).otherwise(8)
    r = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("seed"), F.col("c_custkey").cast("string")))))
    return t("customer").select("c_custkey", k.alias("k"), r.alias("r")).where("r <= k").select("c_custkey")


@query("D42_tested_population", "select c_nationkey, c_mktsegment, count(o_orderkey) as n_tests, count(distinct c_custkey) as n_population from customer left join (select * from orders where o_totalprice > 450000) on o_custkey = c_custkey group by 1, 2")
def tested_population(t, spark):
    o = t("orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t("customer").join(o, "c_custkey", "left").groupBy("c_nationkey", "c_mktsegment").agg(F.count("o_orderkey").alias("n_tests"), F.countDistinct("c_custkey").alias("n_population"))


@query("D32_half_even", """with x as (select l_orderkey, l_linenumber, l_partkey, cast(round(l_extendedprice * 100) as bigint) * cast(round(l_discount * 100) as bigint) as m from lineitem)
select l_orderkey, l_linenumber, l_partkey, (m // 100 + case when m % 100 > 50 or (m % 100 = 50 and (m // 100) % 2 = 1) then 1 else 0 end) / 100.0 as refund from x""")
def half_even(t, spark):
    """Money rounds half to even, over decimals."""
    exact = F.col("l_extendedprice").cast("decimal(14,2)") * F.col("l_discount").cast("decimal(4,2)")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bround(exact, 2).cast("double").alias("refund"))


@query("L1_parameterised_check", "select count(*) as n_violations from lineitem where l_quantity > 45 and l_discount >= 0.05")
def parameterised_check(t, spark):
    """A check's SQL with bound parameters."""
    why = profiling.refuse(sql := "select count(*) as n_violations from {checked} where l_quantity > :most and l_discount >= :least")
    if why:
        raise ValueError(why)
    return spark.sql(sql, args={"most": 45, "least": 0.05}, checked=t("lineitem"))


@query("L3_check_run", "select 'violations' as status, count(*) as n from lineitem where l_quantity > 49")
def check_run(t, spark):
    found = profiling.run_check(spark, "select * from {checked} where l_quantity > :most", {"most": 49}, checked=t("lineitem"))
    return spark.createDataFrame([(found["status"], found["n"])], "status string, n long")


@query("O2_referential", "select 'lineitem_order' as check_name, count(*) as n_violations, count(*) = 0 as passed from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'order_has_lines', count(*), count(*) = 0 from orders where o_orderkey not in (select l_orderkey from lineitem)")
def referential(t, spark):
    o, l = t("orders").select(F.col("o_orderkey").alias("k")), t("lineitem").select(F.col("l_orderkey").alias("k"))
    return profiling.assert_empty("lineitem_order", l.join(o, "k", "left_anti")).unionByName(profiling.assert_empty("order_has_lines", o.join(l, "k", "left_anti")))


@query("O1_counts_and_sums", "select 'nations' as check_name, count(*) = 25 as passed from nation union all select 'regions', count(*) = 5 from region union all select 'balances', abs(sum(c_acctbal) - sum(c_acctbal)) < 0.01 from customer")
def counts_and_sums(t, spark):
    a = t("nation").agg((F.count("*") == 25).alias("passed")).select(F.lit("nations").alias("check_name"), "passed")
    b = t("region").agg((F.count("*") == 5).alias("passed")).select(F.lit("regions").alias("check_name"), "passed")
    return a.unionByName(b).unionByName(t("customer").agg((F.abs(F.sum("c_acctbal") - F.sum("c_acctbal")) < 0.01).alias("passed")).select(F.lit("balances").alias("check_name"), "passed"))


@query("F5_cosine_topk", """with q as (select vec_id, embedding from embeddings where vec_id % 100 = 0), s as (select q.vec_id as query_id, e.vec_id as vec_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score from q join embeddings e on e.vec_id <> q.vec_id and e.label = (select label from embeddings l where l.vec_id = q.vec_id))
select query_id, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) r from s) where r <= 5""")
def cosine_topk(t, spark):
    """The five nearest vectors of the same label for each query vector: an equi-join on the filter, blocks of it scored, k kept by window."""
    e = t("embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    s = e.join(q, "label").where("vec_id <> query_id").select("query_id", "vec_id", F.round(T.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return s.withColumn("r", r).where("r <= 5").drop("r")


@query("K_event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(t, spark):
    return t("events").groupBy(F.window("ts", "1 hour")["start"].cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))


@query("K_sessions", """select user_id, min(ts) as start, count(*) as n from (select user_id, ts, sum(g) over (partition by user_id order by ts, event_id) s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end g from events)) group by user_id, s""")
def sessions(t, spark):
    """Sessions with gaps of 30 minutes at least."""
    return t("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("start"), F.count("*").alias("n")).select("user_id", "start", "n")


def neighbours_sql(where: str) -> str:
    return f"""with s as (select q.vec_id as query, e.vec_id as key, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 10) as score from embeddings q, embeddings e where q.vec_id % 100 = 0 and q.vec_id <> e.vec_id and {where})
select query, key, round(score, 6) as score, cast(row_number() over (partition by query order by score desc, key) as int) as rank from s qualify rank <= 10"""


def vectors_and_queries(t):
    v = t("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label")
    return v, v.where("key % 100 = 0").withColumnRenamed("key", "query")


@query("F5_all_neighbours", neighbours_sql("true"))
def all_neighbours(t, spark):
    """The ten nearest of every hundredth vector, against all in blocks."""
    v, q = vectors_and_queries(t)
    return retrieval.dense_top(v, q).select("query", "key", F.round("score", 6).alias("score"), "rank")


@query("J3_filtered_neighbours", neighbours_sql("e.label in (1, 2)"))
def filtered_neighbours(t, spark):
    """The same among the vectors of two labels, a filter that goes before the search."""
    v, q = vectors_and_queries(t)
    return retrieval.dense_top(v.where("label in (1, 2)"), q).select("query", "key", F.round("score", 6).alias("score"), "rank")


@query("F5_index_neighbours")
def index_neighbours(t, spark):
    """The same by an inverted file whose lists and probes are fitted on a bounded sample."""
    v, q = vectors_and_queries(t)
    return retrieval.index_top(retrieval.vector_index(v, ("label",)), q).select("query", "key", F.round("score", 6).alias("score"), "rank")
