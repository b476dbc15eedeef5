"""Joins, windows, sorting and sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import calendars, joins
from tessera.operators.stages import kept
from tessera.registry import query

DAY = "cast(o_orderdate as date)"


@query("B1_optional_filters", "select p_partkey, p_name, p_size from part where p_brand = 'Brand#17' and p_size between 10 and 30 and p_name ilike '%widget%'")
def optional_filters(t, spark):
    """Filters that apply where they are given."""
    asked = {"brand": "Brand#17", "kind": None, "low": 10, "high": 30, "name": "%widget%"}
    df = t("part")
    if asked["brand"] is not None:
        df = df.where(F.col("p_brand") == asked["brand"])
    if asked["kind"] is not None:
        df = df.where(F.col("p_type") == asked["kind"])
    if asked["low"] is not None:
        df = df.where(F.col("p_size").between(asked["low"], asked["high"]))
    if asked["name"] is not None:
        df = df.where(F.col("p_name").ilike(asked["name"]))
    return df.select("p_partkey", "p_name", "p_size")


@query("B2_filtered_latest", """select o_orderkey, o_custkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders) where n = 1 and o_orderstatus = 'F'""")
def filtered_latest(t, spark):
    return joins.latest_per_key(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("B3_null_safe_parameter", "select p_partkey from part where p_type = 'ECONOMY'")
def null_safe_parameter(t, spark):
    brand, kind = F.lit(None).cast("string"), F.lit("ECONOMY")
    return t("part").where((brand.isNull() | (F.col("p_brand") == brand)) & (kind.isNull() | (F.col("p_type") == kind))).select("p_partkey")


@query("B4_unpivot_deadlines", """select o_orderkey, 'ordered' as kind, cast(o_orderdate as date) as due from orders where cast(o_orderdate as date) between date '1998-01-01' and date '1998-01-31'
union all select l_orderkey, 'shipped', cast(l_shipdate as date) from lineitem where cast(l_shipdate as date) between date '1998-01-01' and date '1998-01-31' and l_linenumber = 1""")
def unpivot_deadlines(t, spark):
    """Two dates of a row as two rows, each only if it falls into the window."""
    first = t("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.array(F.struct(F.lit("shipped").alias("kind"), F.to_date("l_shipdate").alias("due"))).alias("d"))
    ordered = t("orders").select("o_orderkey", F.array(F.struct(F.lit("ordered").alias("kind"), F.to_date("o_orderdate").alias("due"))).alias("d"))
    return ordered.unionByName(first).select("o_orderkey", F.explode("d").alias("d")).select("o_orderkey", "d.*").where("due between date'1998-01-01' and date'1998-01-31'")


@query("B5_recent", "select o_orderkey from orders where cast(o_orderdate as date) >= date '2001-01-01' - 30 and cast(o_orderdate as date) <= date '2001-01-01'")
def recent(t, spark):
    today = F.lit("2001-01-01").cast("date")
    return t("orders").where(F.to_date("o_orderdate").between(F.date_sub(today, 30), today)).select("o_orderkey")


@query("B6_array_membership", "select o_custkey, count(*) as n from orders group by o_custkey having list_contains(list(distinct lower(o_orderpriority)), '1-urgent')")
def array_membership(t, spark):
    held = t("orders").groupBy("o_custkey").agg(F.collect_set(F.lower("o_orderpriority")).alias("p"), F.count("*").alias("n"))
    return held.where(F.array_contains("p", F.lower(F.lit("1-URGENT")))).select("o_custkey", "n")


@query("B7_array_containment", "select o_custkey from orders group by o_custkey having list_has_all(list(distinct o_orderpriority), ['1-URGENT', '5-LOW'])")
def array_containment(t, spark):
    held = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return held.where(F.size(F.array_except(F.array(F.lit("1-URGENT"), F.lit("5-LOW")), "p")) == 0).select("o_custkey")


@query("B12_guarded_cast", "select try_cast(regexp_extract(c_name, '([0-9]+)$', 1) as bigint) as n, c_custkey from customer where regexp_matches(c_name, '#[0-9]+$')")
def guarded_cast(t, spark):
    return t("customer").where(F.col("c_name").rlike("#[0-9]+$")).select(F.regexp_extract("c_name", "([0-9]+)$", 1).try_cast("bigint").alias("n"), "c_custkey")


@query("B13_prefix_continuation", "select c.c_custkey, p.prefix from customer c join (values ('Customer#00000001'), ('Customer#00000010')) p(prefix) on starts_with(c.c_name, p.prefix)")
def prefix_continuation(t, spark):
    """A prefix join as an equi-join on the key that both sides share."""
    prefixes = spark.createDataFrame([("Customer#00000001",), ("Customer#00000010",)], "prefix string")
    return t("customer").withColumn("prefix", F.substring("c_name", 1, 17)).join(F.broadcast(prefixes), "prefix").select("c_custkey", "prefix")


@query("B14_not_distinct", "select l_returnflag, count(*) as n from lineitem where nullif(l_returnflag, 'N') is not distinct from null group by l_returnflag")
def not_distinct(t, spark):
    return t("lineitem").where(F.nullif("l_returnflag", F.lit("N")).eqNullSafe(F.lit(None))).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("B15_json_key", "select event_id from events where json_extract(props, '$.k') is not null and cast(json_extract(props, '$.k') as integer) > 90")
def json_key(t, spark):
    props = F.from_json("props", "map<string,string>")
    return t("events").withColumn("m", props).where(F.map_contains_key("m", F.lit("k")) & (F.col("m")["k"].try_cast("int") > 90)).select("event_id")


@query("B16_validate_records", """select o_orderkey, case when o_totalprice < 1000 then 'price' when o_orderstatus not in ('F', 'O') then 'status' end as reason from orders where o_totalprice < 1000 or o_orderstatus not in ('F', 'O')""")
def validate_records(t, spark):
    """The rejected rows with the first rule that each breaks."""
    reason = F.when(F.col("o_totalprice") < 1000, "price").when(~F.col("o_orderstatus").isin("F", "O"), "status")
    return t("orders").select("o_orderkey", reason.alias("reason")).where("reason is not null")


@query("B20_concat_contains", "select p_partkey from part where contains(lower(concat_ws(' ', p_name, p_brand, replace(p_type, '_', ' '))), 'ring brand#1')")
def concat_contains(t, spark):
    return t("part").where(F.lower(F.concat_ws(" ", "p_name", "p_brand", F.replace("p_type", F.lit("_"), F.lit(" ")))).contains("ring brand#1")).select("p_partkey")


@query("B23_nested_shape", "select c_custkey, concat(c_name, '|', n_name, '|', r_name) as shape from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def nested_shape(t, spark):
    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    df = t("customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    row = df.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).alias("place")).alias("row"))
    return row.select("c_custkey", F.concat_ws("|", "row.name", "row.place.nation", "row.place.region").alias("shape"))


@query("C1_prior_version", """select a.o_orderkey, b.o_orderkey as prior_key, b.o_totalprice as prior_price from (select *, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) p from orders) a left join orders b on a.p = b.o_orderkey""")
def prior_version(t, spark):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("prior_key"), F.lag("o_totalprice").over(w).alias("prior_price"))


@query("C2_latest_per_key", "select o_custkey, o_orderkey, cast(o_orderdate as date) as day from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders) where n = 1")
def latest_per_key(t, spark):
    return joins.latest_per_key(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("C3_earliest_semi", "select o_orderkey, o_custkey from orders where (o_custkey, o_orderdate) in (select o_custkey, min(o_orderdate) from orders group by o_custkey)")
def earliest_semi(t, spark):
    return joins.earliest_rows(t("orders"), "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey")


@query("C6_either_of_two_keys", "select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size = 1) or l_suppkey in (select s_suppkey from supplier where s_nationkey = 3)")
def either_of_two_keys(t, spark):
    """Two joins and an OR of their hits; one join on an OR would be a nested loop."""
    parts = t("part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("by_part"))
    suppliers = t("supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("by_supplier"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left").where("by_part or by_supplier").select("l_orderkey", "l_linenumber")


@query("C9_one_hop", """with o as (select distinct l_orderkey as k from lineitem where l_suppkey in (1, 2, 3)) select distinct l_suppkey as supplier from lineitem join o on k = l_orderkey where l_suppkey not in (1, 2, 3)""")
def one_hop(t, spark):
    """Suppliers that share an order with one of the first three: the orders of these, then their other suppliers."""
    l, start = t("lineitem").select("l_orderkey", "l_suppkey"), [1, 2, 3]
    own = l.where(F.col("l_suppkey").isin(start)).select("l_orderkey").distinct()
    return l.where(~F.col("l_suppkey").isin(start)).join(own, "l_orderkey", "left_semi").select(F.col("l_suppkey").alias("supplier")).distinct()


@query("C11_as_of", """select p.event_id, (select s.event_id from events s where s.user_id = p.user_id and s.event_type = 'signup' and s.ts <= p.ts order by s.ts desc, s.event_id desc limit 1) as signup_id from events p where p.event_type = 'purchase'""")
def as_of(t, spark):
    """Each purchase with its user's last signup until then."""
    e = t("events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    ups = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    return joins.as_of(buys, ups, ["user_id"], "ts", "ts", ["signup_id"], bucket=lambda at: F.to_date(at)).select("event_id", "signup_id")


@query("E19_as_of_forward", """select p.event_id, (select s.event_id from events s where s.user_id = p.user_id and s.event_type = 'error' and s.ts >= p.ts order by s.ts, s.event_id limit 1) as error_id from events p where p.event_type = 'click'""")
def as_of_forward(t, spark):
    e = t("events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    errors = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return joins.as_of(clicks, errors, ["user_id"], "ts", "ts", ["error_id"], forward=True, bucket=lambda at: F.to_date(at)).select("event_id", "error_id")


#: Times of day at which reports are due, on business days and on others.
DUE, DUE_OFF = ["08:00:00", "12:00:00", "16:00:00"], ["10:00:00", "14:00:00"]
HOLIDAY = "(strftime(d, '%m-%d') in ('01-01', '07-04', '11-11', '12-25', '12-26') or (month(d) in (1, 2) and isodow(d) = 1 and ceil(day(d) / 7) = 3) or (month(d) = 5 and isodow(d) = 1 and day(d) > 24) or (month(d) = 9 and isodow(d) = 1 and day(d) <= 7) or (month(d) = 11 and isodow(d) = 4 and ceil(day(d) / 7) = 4) or (month(d) = 11 and isodow(d) = 5 and ceil((day(d) - 1) / 7) = 4))"


@query("E19_reporting_slots", f"""with c as (select cast(d as date) as d from generate_series(timestamp '2023-12-31', timestamp '2024-12-31', interval 1 day) t(d)), b as (select d, isodow(d) >= 6 or {HOLIDAY} as off from c),
s as (select d, d + cast(x as time) as slot from b, unnest(case when off then ['10:00:00', '14:00:00'] else ['08:00:00', '12:00:00', '16:00:00'] end) u(x))
select event_id, min(slot) as due from events join s on slot > ts and slot <= ts + interval 2 day group by 1""")
def reporting_slots(t, spark):
    """When an event must be reported: at the next slot of its day, business days and days off having their own, else at the first of the next day."""
    days = calendars.calendar(spark, "2023-12-31", "2024-12-31", DUE, DUE_OFF)
    return calendars.next_slot(t("events").select("event_id", "ts"), "ts", days).select("event_id", F.col("next_slot").cast("timestamp_ntz").alias("due"))


@query("C12_prefix_exists", "select p_partkey from part where exists (select 1 from supplier where s_nationkey = 5 and starts_with(p_brand, concat('Brand#', cast(s_suppkey % 10 as varchar))))")
def prefix_exists(t, spark):
    keys = t("supplier").where("s_nationkey = 5").select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 10).cast("string")).alias("k")).distinct()
    return t("part").withColumn("k", F.substring("p_brand", 1, 7)).join(keys, "k", "left_semi").select("p_partkey")


@query("C13_stitch_exact_then_part", """with x as (select l_orderkey, min(l_partkey) p from lineitem group by 1), s as (select s_suppkey k from supplier)
select l_orderkey, coalesce((select k from s where k = p), (select k from s where k = p % 50)) as target, case when exists (select 1 from s where k = p) then 'exact' else 'part' end as how from x""")
def stitch_exact_then_part(t, spark):
    """An exact key wins; what it leaves is joined on the coarser one."""
    x = t("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    s = t("supplier").select(F.col("s_suppkey").alias("k"))
    exact = x.join(s, x["p"] == s["k"]).select("l_orderkey", F.col("k").alias("target"), F.lit("exact").alias("how"))
    left = x.join(exact, "l_orderkey", "left_anti")
    part = left.join(s, left["p"] % 50 == s["k"], "left").select("l_orderkey", F.col("k").alias("target"), F.lit("part").alias("how"))
    return exact.unionByName(part)


@query("C14_first_aligned", """select c_custkey, (select o_orderkey from orders where o_custkey = c_custkey and cast(o_orderdate as date) between date '1998-01-01' and date '1998-12-31' order by o_orderdate desc, o_orderkey limit 1) as o_orderkey from customer""")
def first_aligned(t, spark):
    o = t("orders").where(f"{DAY} between date'1998-01-01' and date'1998-12-31'")
    best = joins.latest_per_key(o, ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t("customer").select("c_custkey").join(best, "c_custkey", "left")


@query("C17_action_chains", """select distinct a.o_orderkey as src, b.o_orderkey as dst from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.o_orderdate = b.o_orderdate""")
def action_chains(t, spark):
    o = t("orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return o.join(o.withColumnRenamed("o_orderkey", "dst"), ["o_custkey", "o_orderdate"]).where("o_orderkey < dst").select(F.col("o_orderkey").alias("src"), "dst").distinct()


@query("C19_role_playing_star", """select l.l_orderkey, l.l_linenumber, cn.n_name as customer_nation, sn.n_name as supplier_nation from lineitem l join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
join supplier on s_suppkey = l_suppkey join nation cn on cn.n_nationkey = c_nationkey join nation sn on sn.n_nationkey = s_nationkey""")
def role_playing_star(t, spark):
    n = t("nation").select("n_nationkey", "n_name")
    cn, sn = (F.broadcast(n.select(F.col("n_nationkey").alias(f"{p}_nationkey"), F.col("n_name").alias(name))) for p, name in (("c", "customer_nation"), ("s", "supplier_nation")))
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(sn, "s_nationkey")
    c = t("customer").select("c_custkey", "c_nationkey").join(cn, "c_nationkey")
    return l.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "c_custkey").select("l_orderkey", "l_linenumber", "customer_nation", "supplier_nation")


@query("C20_distinct_cited", "select o_custkey, count(distinct l_partkey) as n_parts from orders join lineitem on o_orderkey = l_orderkey group by o_custkey")
def distinct_cited(t, spark):
    return t("orders").select("o_orderkey", "o_custkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey").groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("n_parts"))


@query("C23_cleared_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def cleared_anti(t, spark):
    return t("customer").select("c_custkey").join(t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("C24_reviewed_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def reviewed_semi(t, spark):
    return t("customer").select("c_custkey").join(t("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("C25_correlated_counts", "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n_orders, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'F') as n_done from customer")
def correlated_counts(t, spark):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("a"), F.count_if(F.col("o_orderstatus") == "F").alias("b"))
    return t("customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("a", F.lit(0)).alias("n_orders"), F.coalesce("b", F.lit(0)).alias("n_done"))


@query("C26_shared_reference_pairs", """with r as (select l_partkey, s_nationkey, min(l_orderkey) as rep from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2)
select a.l_partkey, a.s_nationkey as nation_a, b.s_nationkey as nation_b, a.rep as rep_a, b.rep as rep_b from r a join r b on a.l_partkey = b.l_partkey and a.s_nationkey < b.s_nationkey""")
def shared_reference_pairs(t, spark):
    """Nations that share a part, each by its smallest order: one representative for a (part, nation), of which there are at most 25 a part."""
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    r = t("lineitem").join(s, "l_suppkey").groupBy("l_partkey", "s_nationkey").agg(F.min("l_orderkey").alias("rep"))
    b = r.select("l_partkey", F.col("s_nationkey").alias("nation_b"), F.col("rep").alias("rep_b"))
    return r.select("l_partkey", F.col("s_nationkey").alias("nation_a"), F.col("rep").alias("rep_a")).join(b, "l_partkey").where("nation_a < nation_b")


@query("C27_band_pairs", """select a.o_orderkey as left_key, b.o_orderkey as right_key from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.o_orderpriority <> b.o_orderpriority and abs(date_diff('day', cast(a.o_orderdate as date), cast(b.o_orderdate as date))) <= 30""")
def band_pairs(t, spark):
    """Orders of one customer at most 30 days apart and of different priorities."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    side = lambda p: o.select(*[F.col(c).alias(f"{p}_{n}") for c, n in (("o_orderkey", "key"), ("o_custkey", "cust"), ("o_orderpriority", "kind"), ("day", "day"))])
    differ = (F.col("left_key") < F.col("right_key")) & (F.col("left_kind") != F.col("right_kind"))
    return joins.band_join(side("left"), side("right"), "left_day", "right_day", 30, differ, F.col("left_cust") == F.col("right_cust")).select("left_key", "right_key")


@query("C30_resolve_references", """with r as (select l_orderkey as src, l_partkey as ref, 'part' as kind from lineitem union all select l_orderkey, l_suppkey + 95, 'supplier' from lineitem)
select src, kind, ref, coalesce(p_partkey, s_suppkey) is not null as resolved from (select distinct * from r) left join part on kind = 'part' and p_partkey = ref left join supplier on kind = 'supplier' and s_suppkey = ref""")
def resolve_references(t, spark):
    """One join for each kind of reference, and a union."""
    l = t("lineitem")
    out = None
    for kind, ref, table, key in (("part", F.col("l_partkey"), "part", "p_partkey"), ("supplier", F.col("l_suppkey") + 95, "supplier", "s_suppkey")):
        refs = l.select(F.col("l_orderkey").alias("src"), F.lit(kind).alias("kind"), ref.alias("ref")).distinct()
        hit = refs.join(t(table).select(F.col(key).alias("ref"), F.lit(True).alias("hit")), "ref", "left").select("src", "kind", "ref", F.coalesce("hit", F.lit(False)).alias("resolved"))
        out = hit if out is None else out.unionByName(hit)
    return out


@query("C32_term_usage", """with terms as (select distinct p_type as term from part), w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from documents)
select lower(term) as term, count(*) as n from terms join w on lower(w) in (lower(term), lower(term) || 's') group by 1""")
def term_usage(t, spark):
    """Whole-word uses of terms, plural or not: words meet terms in an equi-join."""
    terms = t("part").select(F.lower("p_type").alias("term")).distinct()
    forms = terms.select("term", F.explode(F.array("term", F.concat("term", F.lit("s")))).alias("w"))
    words = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    return words.join(F.broadcast(forms), "w").groupBy("term").agg(F.sum("n").alias("n"))


@query("C33_nearest_date", """select o_custkey, arg_min(o_orderkey, (abs(date_diff('day', date '1998-06-15', cast(o_orderdate as date))), o_orderdate, o_orderkey)) as o_orderkey from orders group by o_custkey""")
def nearest_date(t, spark):
    return joins.nearest(t("orders").withColumn("day", F.to_date("o_orderdate")), ["o_custkey"], "day", F.lit("1998-06-15").cast("date"), "o_orderkey")


@query("C40_longest_prefix", """with ids as (select distinct cast(s_suppkey as varchar) as id from supplier) select cast(l_partkey as varchar) as part, max(id) filter (where starts_with(cast(l_partkey as varchar), id) and length(id) < length(cast(l_partkey as varchar))) as parent from (select distinct l_partkey from lineitem) cross join ids group by 1""")
def longest_prefix(t, spark):
    """The longest proper prefix that is an id too: explode prefixes, equi-join, take the longest."""
    ids = t("supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    p = t("lineitem").select(F.col("l_partkey").cast("string").alias("part")).distinct()
    cut = p.select("part", F.explode_outer(F.expr("case when length(part) > 1 then transform(sequence(1, length(part) - 1), i -> substring(part, 1, i)) end")).alias("id"))
    return cut.join(ids.withColumn("hit", F.col("id")), "id", "left").groupBy("part").agg(F.max_by("hit", F.when(F.col("hit").isNotNull(), F.length("hit"))).alias("parent"))


@query("C41_reconcile", """with e as (select l_orderkey k, l_linenumber n, sum(l_quantity) q from lineitem group by 1, 2), a as (select k, n, case when k % 7 = 0 then q + 1 else q end q from e where k % 11 <> 0 union all select k + 100000, n, q from e where k % 13 = 0)
select coalesce(e.k, a.k) as k, coalesce(e.n, a.n) as n, case when a.k is null then 'missing' when e.k is null then 'unexpected' else 'changed' end as state from e full join a on e.k = a.k and e.n = a.n where a.k is null or e.k is null or e.q <> a.q""")
def reconcile(t, spark):
    e = t("lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.sum("l_quantity").alias("q"))
    a = e.where("k % 11 <> 0").withColumn("q", F.when(F.col("k") % 7 == 0, F.col("q") + 1).otherwise(F.col("q"))).unionByName(e.where("k % 13 = 0").withColumn("k", F.col("k") + 100000))
    return joins.reconcile(e, a, ["k", "n"], ["q"])


@query("C42_rows_with_rollup", "select n_name, count(c_custkey) as n_customers, coalesce(round(sum(c_acctbal), 2), 0) as balance from nation left join customer on c_nationkey = n_nationkey group by n_name")
def rows_with_rollup(t, spark):
    c = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    return t("nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n_customers"), F.coalesce(F.round("b", 2), F.lit(0.0)).alias("balance"))


@query("C43_scope_pack", "select p_partkey from part where p_brand = 'Brand#1' or p_size between 3 and 4 or regexp_matches(p_name, '^red')")
def scope_pack(t, spark):
    p = t("part")
    picked = p.where("p_brand = 'Brand#1'").unionByName(p.where("p_size between 3 and 4")).unionByName(p.where(F.col("p_name").rlike("^red")))
    return picked.select("p_partkey").distinct()


@query("E3_boolean_first_rank", "select o_orderkey, row_number() over (partition by o_custkey order by (o_orderstatus = 'O') desc, o_orderdate, o_orderkey) as n from orders")
def boolean_first_rank(t, spark):
    w = Window.partitionBy("o_custkey").orderBy((F.col("o_orderstatus") == "O").desc(), "o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("n"))


@query("E4_version_chain", "select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as prior_key from orders")
def version_chain(t, spark):
    return t("orders").select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("prior_key"))


@query("E5_version_delta", "select o_orderkey, round(o_totalprice - lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey), 2) as delta from orders")
def version_delta(t, spark):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("delta"))


@query("E6_label_first_date", "select o_orderkey, case when o_orderdate = min(o_orderdate) over (partition by o_custkey) then 'S1' else 'S2' end as snapshot from orders")
def label_first_date(t, spark):
    return t("orders").select("o_orderkey", F.when(F.col("o_orderdate") == F.min("o_orderdate").over(Window.partitionBy("o_custkey")), "S1").otherwise("S2").alias("snapshot"))


@query("E7_best_match", "select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as o_orderkey from orders group by o_custkey")
def best_match(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("E8_primary_by_priority", "select o_custkey, min(o_orderpriority) as primary_path, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as paths from orders group by o_custkey")
def primary_by_priority(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("primary_path"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("paths"))


@query("E9_newest_new", "select user_id, max(ts) as ts from events where event_type = 'signup' and event_id % 3 <> 0 group by user_id")
def newest_new(t, spark):
    return t("events").where("event_type = 'signup' and event_id % 3 <> 0").groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["ts"].alias("ts"))


@query("E10_basis_beats", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, o_orderkey) n from orders) where n = 1")
def basis_beats(t, spark):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return joins.latest_per_key(t("orders"), ["o_custkey"], [rank, F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("E11_run_collapse", "select user_id, event_id from (select *, max(case when event_type = 'signup' then ts end) over (partition by user_id) as done from events) where event_type = 'error' and ts > done")
def run_collapse(t, spark):
    done = F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(Window.partitionBy("user_id"))
    return t("events").withColumn("done", done).where("event_type = 'error' and ts > done").select("user_id", "event_id")


@query("E18_carry_forward_groups", """select conv_id, turn, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as group_no from conversations""")
def carry_forward_groups(t, spark):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("group_no"))


@query("E15_carry_forward_state", """select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn) as last_user_turn from conversations""")
def carry_forward_state(t, spark):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("last_user_turn"))


@query("F1_page_and_total", "select o_orderkey, (select count(*) from orders where o_orderstatus = 'F') as total from orders where o_orderstatus = 'F' order by o_orderdate desc nulls last, o_orderkey limit 25 offset 50")
def page_and_total(t, spark):
    """A page and the number of all: two small results, not a window over the table."""
    df = t("orders").where("o_orderstatus = 'F'")
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").offset(50).limit(25).select("o_orderkey").join(F.broadcast(total))


@query("F2_case_rank", "select o_orderkey from orders order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, o_totalprice desc, o_orderkey limit 40")
def case_rank(t, spark):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return t("orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey")


@query("F3_boolean_first", "select c_custkey from customer order by (c_mktsegment = 'MACHINERY') desc, c_acctbal desc, c_custkey limit 30")
def boolean_first(t, spark):
    return t("customer").orderBy((F.col("c_mktsegment") == "MACHINERY").desc(), F.desc("c_acctbal"), "c_custkey").limit(30).select("c_custkey")


@query("F6_sample_rows", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_discount > 0.09 order by l_orderkey, l_linenumber, l_partkey limit 20")
def sample_rows(t, spark):
    return t("lineitem").where("l_discount > 0.09").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(20).select("l_orderkey", "l_linenumber", "l_partkey")


@query("F7_top_findings", "select o_orderkey, o_orderstatus from orders order by o_orderpriority, o_orderstatus, o_totalprice desc, o_orderkey limit 7")
def top_findings(t, spark):
    return t("orders").orderBy("o_orderpriority", "o_orderstatus", F.desc("o_totalprice"), "o_orderkey").limit(7).select("o_orderkey", "o_orderstatus")


@query("F8_ranked_search", "select p_partkey, substr(p_name, 1, 12) as snippet from part where p_name ilike '%red%' or p_brand ilike '%7%' order by case when p_brand ilike '%7%' then 0 else 1 end, p_partkey limit 25")
def ranked_search(t, spark):
    hit = F.col("p_brand").ilike("%7%")
    return t("part").where(F.col("p_name").ilike("%red%") | hit).orderBy(F.when(hit, 0).otherwise(1), "p_partkey").limit(25).select("p_partkey", F.substring("p_name", 1, 12).alias("snippet"))


@query("F9_newest_unlinked", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') order by o_orderdate desc, o_orderkey limit 100")
def newest_unlinked(t, spark):
    linked = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").join(linked, "o_orderkey", "left_anti").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey")


@query("F10_top_groups", "select l_suppkey, round(sum(l_extendedprice), 2) as total from lineitem group by l_suppkey order by total desc, l_suppkey limit 20")
def top_groups(t, spark):
    return t("lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total")).orderBy(F.desc("total"), "l_suppkey").limit(20)


@query("F12_most_cited_first", "select p_partkey, count(l_partkey) as n from part left join lineitem on l_partkey = p_partkey group by p_partkey order by n desc, p_partkey limit 50")
def most_cited_first(t, spark):
    n = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("c"))
    return t("part").select("p_partkey").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("c", F.lit(0)).alias("n")).orderBy(F.desc("n"), "p_partkey").limit(50)


@query("G1_timeline_union", "select 'order' as kind, o_orderkey as id, cast(o_orderdate as date) as day from orders where o_custkey = 7 union all select 'ship', l_orderkey, cast(l_shipdate as date) from lineitem join orders on l_orderkey = o_orderkey where o_custkey = 7")
def timeline_union(t, spark):
    o = t("orders").where("o_custkey = 7")
    ships = t("lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.lit("ship").alias("kind"), F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("day"))
    return o.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day")).unionByName(ships).orderBy(F.asc_nulls_first("day"))


@query("G2_leak_shingles", """with g as (select 'd' as side, doc_id as id, string_split(lower(text), ' ') as w from documents union all select 'b', item_id, string_split(lower(text), ' ') from benchmark),
s as (select side, id, array_to_string(w[i:i + 5], ' ') as g from (select side, id, w, unnest(generate_series(1, len(w) - 5)) as i from g where len(w) >= 6)) select d.id as doc_id, b.id as item_id, count(distinct d.g) as n_shared from s d join s b on d.g = b.g where d.side = 'd' and b.side = 'b' group by 1, 2""")
def leak_shingles(t, spark):
    """Six-word runs that documents share with the benchmark, by their hashes, counted for each pair."""

    def runs(df, key):
        w = df.select(key, F.split(F.lower("text"), " ").alias("w")).where("size(w) >= 6")
        return w.select(key, F.explode(T.shingles(F.col("w"), 6, hashed=True)).alias("g"))

    return runs(t("documents"), "doc_id").join(runs(t("benchmark"), "item_id"), "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))


@query("G3_symmetric_difference", "(select o_custkey as k from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'P') union all (select o_custkey from orders where o_orderstatus = 'P' except select o_custkey from orders where o_orderstatus = 'F')")
def symmetric_difference(t, spark):
    """One aggregate tells both sides of every key."""
    o = t("orders").where("o_orderstatus in ('F', 'P')").groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "P").alias("p"))
    return o.where("f <> p").select("k")


@query("G4_multiset_difference", "select l_partkey, l_quantity from lineitem where l_returnflag = 'A' except all select l_partkey, l_quantity from lineitem where l_returnflag = 'N'")
def multiset_difference(t, spark):
    l = t("lineitem")
    return l.where("l_returnflag = 'A'").select("l_partkey", "l_quantity").exceptAll(l.where("l_returnflag = 'N'").select("l_partkey", "l_quantity"))


@query("G5_ordered_dedupe", """select conv_id, string_agg(role, '>' order by first) as roles from (select conv_id, role, min(turn) as first from conversations group by 1, 2) group by conv_id""")
def ordered_dedupe(t, spark):
    c = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", F.array_join(F.array_distinct(F.transform("r", lambda x: x["role"])), ">").alias("roles"))


@query("G6_links_both_ways", "with e as (select distinct l_partkey a, l_suppkey + 1000000 b from lineitem) select a as node, b as other from e union select b, a from e")
def links_both_ways(t, spark):
    e = t("lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"))
    return joins.neighbours(e, "a", "b", loops=True)


@query("G8_missing_points", "select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def missing_points(t, spark):
    return t("documents").select("doc_id").join(t("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("K2_change_detect", """with s as (select o_orderkey k, md5(concat_ws('|', o_custkey, o_orderstatus)) h from orders where o_orderkey % 5 <> 0), n as (select o_orderkey k, md5(concat_ws('|', o_custkey, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end)) h from orders where o_orderkey % 2 = 0)
select n.k, case when s.k is null then 'new' when s.h = n.h then 'unchanged' else 'changed' end as state from n left join s on n.k = s.k""")
def change_detect(t, spark):
    o = t("orders")
    hashed = lambda status: F.md5(F.concat_ws("|", F.col("o_custkey").cast("string"), status))
    s = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), hashed(F.col("o_orderstatus")).alias("old"))
    n = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), hashed(F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("h"))
    return n.join(s, "k", "left").select("k", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("h"), "unchanged").otherwise("changed").alias("state"))


@query("A24_upsert", """with s as (select o_orderkey k, o_totalprice p from orders where o_orderkey % 5 <> 0), n as (select o_orderkey k, o_totalprice + 1 p from orders where o_orderkey % 2 = 0)
select coalesce(n.k, s.k) as k, coalesce(n.p, s.p) as p from s full join n on s.k = n.k""")
def upsert(t, spark):
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    return joins.upsert(o.where("k % 5 <> 0"), o.where("k % 2 = 0").withColumn("p", F.col("p") + 1), ["k"])


@query("A30_backfill", "select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), case when o_orderpriority < '3' then 'U' else 'V' end) as status from orders")
def backfill(t, spark):
    mapped = spark.createDataFrame([("1-URGENT", "U"), ("2-HIGH", "U"), ("3-MEDIUM", "V"), ("4-NOT SPECIFIED", "V"), ("5-LOW", "V")], "o_orderpriority string, m string")
    return t("orders").join(F.broadcast(mapped), "o_orderpriority", "left").select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), "m").alias("status"))


@query("A26_mark_stale", "select o_orderkey, o_orderkey = max(o_orderkey) over (partition by o_custkey) as is_current from orders")
def mark_stale(t, spark):
    return t("orders").select("o_orderkey", (F.col("o_orderkey") == F.max("o_orderkey").over(Window.partitionBy("o_custkey"))).alias("is_current"))


@query("N3_depth_first_tree", """with recursive t as (select n_nationkey as id, cast(lpad(cast(n_nationkey as varchar), 4, '0') as varchar) as path, 0 as depth from nation where n_nationkey = 1
union all select n.n_nationkey, t.path || '/' || lpad(cast(n.n_nationkey as varchar), 4, '0'), t.depth + 1 from nation n join t on n.n_nationkey // 2 = t.id and n.n_nationkey > 1) select id, path, depth from t""")
def depth_first_tree(t, spark):
    """A tree by parent = key / 2, each node with its path, which sorts depth first."""
    return spark.sql("""with recursive t(id, path, depth) as (select n_nationkey, lpad(cast(n_nationkey as string), 4, '0'), 0 from {nodes} where n_nationkey = 1
        union all select n.n_nationkey, concat(t.path, '/', lpad(cast(n.n_nationkey as string), 4, '0')), t.depth + 1 from {nodes} n join t on n.n_nationkey div 2 = t.id where n.n_nationkey > 1) select id, path, depth from t""", nodes=t("nation"))


@query("N4_parent_depth", "select n_nationkey as id, floor(log2(n_nationkey)) as depth from nation where n_nationkey >= 1")
def parent_depth(t, spark):
    return t("nation").where("n_nationkey >= 1").select(F.col("n_nationkey").alias("id"), F.floor(F.log2("n_nationkey")).cast("double").alias("depth"))


@query("N4_clause_tree", """with i as (select p_partkey as k, array_to_string(string_split(cast(p_partkey as varchar), ''), '.') as id from part)
select c.id, max(p.id) as parent_id, count(p.id) as depth from i c left join i p on starts_with(c.id, p.id || '.') group by 1""")
def clause_tree(t, spark):
    """Numbered clauses ("1.2.7") under the nearest one that is there, with their depth; a parent is looked up among a clause's own prefixes."""
    digits = F.filter(F.split(F.col("p_partkey").cast("string"), ""), lambda d: d != "")
    ids = kept(t("part").select(F.array_join(digits, ".").alias("id")))
    return joins.tree(ids, "id")


@query("B21_tree_filter", """with i as (select array_to_string(string_split(cast(p_partkey as varchar), ''), '.') as id, p_size <> 13 as shown, contains(p_name, 'red') as found from part), m as (select id from i where shown and found)
select id, found as hit from i where shown and exists (select 1 from m where m.id = i.id or starts_with(m.id, i.id || '.'))""")
def tree_filter(t, spark):
    """A section tree without what is hidden, down to the sections that a word is found in."""
    digits = F.filter(F.split(F.col("p_partkey").cast("string"), ""), lambda d: d != "")
    nodes = kept(t("part").select(F.array_join(digits, ".").alias("id"), "p_size", "p_name"))
    return joins.tree_filter(nodes, "id", F.col("p_size") != 13, F.contains("p_name", F.lit("red"))).select("id", "hit")


@query("D31_samples_of_groups", """with g as (select l_partkey as k, count(*) as n from lineitem where l_quantity > 30 group by 1), s as (select l_partkey as k, count(*) as m from lineitem where l_returnflag = 'R' group by 1)
select k as l_partkey, coalesce(n, 0) as n_group, coalesce(m, 0) as n_sample, coalesce(m, 0) <= coalesce(n, 0) as is_within, round(case when n > 0 then coalesce(m, 0) / n end, 6) as share from g full join s using (k)""")
def samples_of_groups(t, spark):
    """Each group's sample beside the group: one aggregate has both."""
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    g = t("lineitem").groupBy("l_partkey").agg(n("l_quantity > 30", "n_group"), n("l_returnflag = 'R'", "n_sample")).where("n_group + n_sample > 0")
    return g.select("l_partkey", "n_group", "n_sample", (F.col("n_sample") <= F.col("n_group")).alias("is_within"), F.round(F.when(F.col("n_group") > 0, F.col("n_sample") / F.col("n_group")), 6).alias("share"))


@query("H31_merged_in_order", """with c as (select user_id, event_type as name, case when value >= 1 then value end as v, ts, event_id from events union all select user_id, 'last', value, ts, event_id from events), l as (select user_id, name, arg_max_null(v, (ts, event_id)) as v from c group by 1, 2)
select user_id, coalesce(string_agg(name || '=' || cast(cast(round(v * 100, 0) as bigint) as varchar), ',' order by name) filter (v is not null), '') as merged from l group by 1""")
def merged_in_order(t, spark):
    """Each user's events as maps, merged in the order of their times: the last value of each kind, small ones take theirs out."""
    value = F.when(F.col("value") >= 1, F.col("value"))
    e = t("events").select("user_id", "ts", "event_id", F.create_map("event_type", value, F.lit("last"), "value").alias("m"))
    merged = joins.merged_maps(e, ["user_id"], ["ts", "event_id"], "m")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"] * 100, 0).cast("long").cast("string"))), ",")
    return merged.select("user_id", text.alias("merged"))
