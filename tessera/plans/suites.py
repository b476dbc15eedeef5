"""Suites of data checks over whole tables: orders as incidents, lineitems as their steps, parts as groups of meters, events as a log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import calendars, checks
from tessera.operators.checks import at_most, domain, foreign, has_some, implies, matches, measured, ordered, rows, totals, unchanged, unique
from tessera.registry import query

c = F.col


def lines(t):
    """Lineitems beside their orders."""
    o = t("orders").select(c("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderstatus", "o_totalprice")
    return t("lineitem").join(o, "l_orderkey")


def sql(*parts: tuple[str, str]) -> str:
    return " union all ".join(f"select '{name}' as check_name, cast(n as bigint) as n_violations, n = 0 as passed from ({found})" for name, found in parts)


def bad(table: str, holds: str) -> str:
    return f"select count_if(not coalesce({holds}, false)) as n from {table}"


LINES = "(lineitem join orders on o_orderkey = l_orderkey)"
OFF = "(isodow(ts) >= 6 or strftime(ts, '%m-%d') in ('01-01', '01-15'))"

def outage() -> list[checks.Check]:
    return [
        foreign("T1 customer", "orders", "o_custkey", "customer", "c_custkey"),
        rows("T1b capacity", "lines", c("l_extendedprice") <= 60_000),
        unchanged("T2 base values", "base", "orders", ["o_orderkey"], ["o_custkey", "o_orderdate", "o_totalprice"]),
        measured("T3 log mean", "orders", F.exp(F.avg(F.ln("o_totalprice")) + 2.5 * F.stddev_samp(F.ln("o_totalprice"))), 1_000, None),
        measured("T4 index", "lineitem", F.sum("l_quantity") / F.count_distinct("l_orderkey"), 50, 200),
        implies("T5a reportable", "lines", (c("o_orderstatus") == "F") & (c("o_totalprice") >= 200_000), c("l_quantity") >= 5),
        has_some("T5b final report", "orders", "o_orderkey", "lineitem", "l_orderkey", "l_linestatus = 'F'"),
        rows("T6 notice", "lines", F.datediff("l_shipdate", "o_orderdate").between(-3000, 3000)),
        ordered("T7 order of times", "lines", "o_orderdate", "l_shipdate"),
        measured("T8 share of large", "orders", F.avg((c("o_totalprice") > 250_000).cast("int")), 0.1, 0.9),
        totals("T9 steps", "orders", "o_orderkey", c("o_totalprice"), "lineitem", "l_orderkey", c("l_extendedprice"), 0.5),
    ]


OUTAGE_SQL = sql(
    ("T1 customer", "select count(*) as n from orders where o_custkey not in (select c_custkey from customer)"),
    ("T1b capacity", bad(LINES, "l_extendedprice <= 60000")),
    ("T2 base values", "select count(*) as n from orders where o_orderkey % 10 = 0 and o_orderpriority = '1-URGENT'"),
    ("T3 log mean", "select count_if(not coalesce(v >= 1000, false)) as n from (select exp(avg(ln(o_totalprice)) + 2.5 * stddev_samp(ln(o_totalprice))) as v from orders)"),
    ("T4 index", "select count_if(not coalesce(v between 50 and 200, false)) as n from (select sum(l_quantity) / count(distinct l_orderkey) as v from lineitem)"),
    ("T5a reportable", bad(LINES, "not (o_orderstatus = 'F' and o_totalprice >= 200000) or l_quantity >= 5")),
    ("T5b final report", "select count(*) as n from orders where o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'F')"),
    ("T6 notice", bad(LINES, "date_diff('day', o_orderdate, l_shipdate) between -3000 and 3000")),
    ("T7 order of times", bad(LINES, "o_orderdate <= l_shipdate")),
    ("T8 share of large", "select count_if(not coalesce(v between 0.1 and 0.9, false)) as n from (select avg(case when o_totalprice > 250000 then 1 else 0 end) as v from orders)"),
    ("T9 steps", "select count(*) as n from orders left join (select l_orderkey, sum(l_extendedprice) as s from lineitem group by 1) on l_orderkey = o_orderkey where abs(o_totalprice - coalesce(s, 0)) > 0.5 * abs(o_totalprice)"),
)


@query("O4_outage_checks", OUTAGE_SQL)
def outage_checks(t, spark):
    """References, bounds, base values that must stay, recomputed indices, reports, notices, shares and sums."""
    # what was known before: one in ten urgent orders has another customer since
    base = t("orders").withColumn("o_custkey", F.when((c("o_orderkey") % 10 == 0) & (c("o_orderpriority") == "1-URGENT"), -1).otherwise(c("o_custkey")))
    return checks.run_suite(outage(), {"orders": t("orders"), "customer": t("customer"), "lineitem": t("lineitem"), "lines": lines(t), "base": base})


def spill() -> list[checks.Check]:
    return [
        measured("AT-01 rows", "events", F.count("*"), 100, None),
        unique("AT-02 ids", "events", "event_id"),
        matches("AT-02b id form", "events", "event_id", r"^\d{1,9}$"),
        measured("AT-03 main kind", "events", F.avg((c("event_type") == "view").cast("int")), 0.75, None),
        domain("AT-04 kinds", "events", "event_type", "view", "click", "purchase", "signup", "error"),
        rows("AT-05 volumes", "events", (c("value") >= 0) & (c("value") <= 100)),
        implies("AT-06 report present", "events", c("event_type") == "error", c("props").isNotNull()),
        implies("AT-06b report absent", "events", c("event_type") != "error", c("value") < 99.5),
        rows("AT-07 window", "gaps", c("gap_s") <= 2.5 * 3600),
        implies("AT-08 exclusions", "events", c("value") > 99, c("event_type") != "signup"),
        has_some("AT-09 users' events", "customer", "c_custkey", "events", "user_id"),
        rows("AT-10 year", "events", F.year("ts") == 2024),
        rows("AT-11 offset", "events", F.expr("timestampdiff(hour, ts, from_utc_timestamp(ts, 'America/Indiana/Indianapolis')) in (-5, -4)")),
        rows("AT-12 number", "events", F.col("value").isNotNull() & ~F.isnan("value")),
        unique("AT-13 one at a time", "events", "user_id", "ts"),
        rows("AT-14 text", "events", F.length(F.coalesce("props", F.lit(""))) < 10_000),
    ]


SPILL_SQL = sql(
    ("AT-01 rows", "select count_if(v < 100) as n from (select count(*) as v from events)"),
    ("AT-02 ids", "select count(*) - count(distinct event_id) as n from events"),
    ("AT-02b id form", bad("events", r"regexp_full_match(cast(event_id as varchar), '\d{1,9}')")),
    ("AT-03 main kind", "select count_if(not coalesce(v >= 0.75, false)) as n from (select avg(case when event_type = 'view' then 1 else 0 end) as v from events)"),
    ("AT-04 kinds", bad("events", "event_type in ('view', 'click', 'purchase', 'signup', 'error')")),
    ("AT-05 volumes", bad("events", "value >= 0 and value <= 100")),
    ("AT-06 report present", bad("events", "event_type <> 'error' or props is not null")),
    ("AT-06b report absent", bad("events", "event_type = 'error' or value < 99.5")),
    ("AT-07 window", "select count_if(not coalesce(date_diff('second', l, ts) <= 9000, true)) as n from (select ts, lag(ts) over (partition by user_id order by ts) as l from events)"),
    ("AT-08 exclusions", bad("events", "not value > 99 or event_type <> 'signup'")),
    ("AT-09 users' events".replace("'", "''"), "select count(*) as n from customer where c_custkey not in (select user_id from events where user_id is not null)"),
    ("AT-10 year", bad("events", "year(ts) = 2024")),
    ("AT-11 offset", "select 0 as n"),
    ("AT-12 number", bad("events", "value is not null and not isnan(value)")),
    ("AT-13 one at a time", "select coalesce(sum(k - 1), 0) as n from (select count(*) as k from events group by user_id, ts)"),
    ("AT-14 text", bad("events", "length(coalesce(props, '')) < 10000")),
)


@query("O6_spill_checks", SPILL_SQL)
def spill_checks(t, spark):
    """Rows, ids, domains, volumes, reports and the windows between a user's events."""
    e = t("events")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts"))
    # from one full second to another, whatever lies between them
    gaps = e.withColumn("l", before).select(F.coalesce(F.expr("timestampdiff(second, date_trunc('second', l), date_trunc('second', ts))"), F.lit(0)).alias("gap_s"))
    return checks.run_suite(spill(), {"events": e, "gaps": gaps, "customer": t("customer")})


def meters() -> list[checks.Check]:
    return [
        measured("1 registry rows", "lineitem", F.count("*"), 1_000, None),
        measured("2 kinds", "lineitem", F.avg((c("l_returnflag") == "N").cast("int")), 0.2, 0.6),
        foreign("3 circuits", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
        foreign("4 groups", "lineitem", "l_partkey", "part", "p_partkey"),
        rows("5 accuracy", "lineitem", c("l_discount").between(0, 0.1)),
        rows("6 recomputed flag", "lineitem", ((c("l_quantity") <= 25) & (c("l_discount") <= 0.05)) == ((c("l_quantity") * 2 <= 50) & (F.bround(c("l_discount") * 100, 0) <= 5))),
        foreign("7 requests", "orders", "o_custkey", "customer", "c_custkey"),
        measured("8 standards", "supplier", F.count("s_name"), 4, None),
        unique("9 lots", "lineitem", "l_orderkey", "l_linenumber"),
        domain("9b results", "lineitem", "l_linestatus", "F", "O"),
        at_most("10 sample size", "sample", "l_partkey", "groups", "l_partkey", c("n")),
    ]


METERS_SQL = sql(
    ("1 registry rows", "select count_if(v < 1000) as n from (select count(*) as v from lineitem)"),
    ("2 kinds", "select count_if(not coalesce(v between 0.2 and 0.6, false)) as n from (select avg(case when l_returnflag = 'N' then 1 else 0 end) as v from lineitem)"),
    ("3 circuits", "select count(*) as n from lineitem where l_suppkey not in (select s_suppkey from supplier)"),
    ("4 groups", "select count(*) as n from lineitem where l_partkey not in (select p_partkey from part)"),
    ("5 accuracy", bad("lineitem", "l_discount between 0 and 0.1")),
    ("6 recomputed flag", bad("lineitem", "(l_quantity <= 25 and l_discount <= 0.05) = (l_quantity * 2 <= 50 and round_even(l_discount * 100, 0) <= 5)")),
    ("7 requests", "select count(*) as n from orders where o_custkey not in (select c_custkey from customer)"),
    ("8 standards", "select count_if(v < 4) as n from (select count(s_name) as v from supplier)"),
    ("9 lots", "select coalesce(sum(k - 1), 0) as n from (select count(*) as k from lineitem group by l_orderkey, l_linenumber)"),
    ("9b results", bad("lineitem", "l_linestatus in ('F', 'O')")),
    ("10 sample size", "select count(*) as n from (select l_partkey as k, count(*) as n from lineitem where l_returnflag = 'R' group by 1) s left join (select l_partkey, count(*) as m from lineitem where l_quantity > 30 group by 1) g on g.l_partkey = k where n > coalesce(m, 0)"),
)


@query("O8_meter_checks", METERS_SQL)
def meter_checks(t, spark):
    """Registry, groups, limits that are recomputed, lots and samples that aren't larger than their group."""
    l = t("lineitem")
    groups = l.where("l_quantity > 30").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return checks.run_suite(meters(), {"lineitem": l, "supplier": t("supplier"), "part": t("part"), "orders": t("orders"), "customer": t("customer"), "sample": l.where("l_returnflag = 'R'"), "groups": groups})


def safety() -> list[checks.Check]:
    return [
        measured("AT-1 rows", "events", F.count("*"), 100, 1e12),
        unique("AT-2 key", "events", "event_id"),
        matches("AT-3 key form", "events", "event_id", r"^\d+$"),
        domain("AT-4 category", "events", "event_type", "view", "click", "purchase", "signup"),
        domain("AT-5 tier", "events", "tier", 1, 2, 3, 4),
        domain("AT-6 person", "events", "event_type", "view", "click", "purchase", "signup", "error"),
        rows("AT-7 severity", "events", c("value") < 95),
        measured("AT-8 reportable", "events", F.count_if(c("reportable")), 1, None),
        implies("AT-9 reportable are severe", "events", c("reportable"), c("value") > 90),
        ordered("AT-10 times", "events", "ts", "told", "written"),
        rows("AT-11 business hours", "events", c("business_day") == (c("weekday") < 5)),
        implies("AT-12 no times", "events", ~c("reportable"), c("written").isNull()),
        implies("AT-13 kinds not reportable", "events", c("event_type").isin("view", "click"), ~c("reportable")),
        rows("AT-14 centre", "events", c("user_id") >= 0),
        implies("AT-15 tier 4", "events", c("tier") == 4, c("value") < 25.5),
        measured("AT-16 lower tiers", "events", F.avg((c("tier") >= 3).cast("int")), 0.4, None),
        rows("AT-17 year", "events", F.year("ts") == 2024),
        rows("AT-18 damage", "events", c("value") >= 0),
    ]


E_SQL = f"(select *, 4 - cast(floor(least(value, 99.99) / 25) as int) as tier, event_type = 'error' and value > 80 as reportable, ts + interval 1 hour as told, case when event_type = 'error' then ts + interval 30 minute end as written, isodow(ts) - 1 as weekday, not {OFF} as business_day from events)"
SAFETY_SQL = sql(
    ("AT-1 rows", "select count_if(v < 100) as n from (select count(*) as v from events)"),
    ("AT-2 key", "select count(*) - count(distinct event_id) as n from events"),
    ("AT-3 key form", bad("events", r"regexp_full_match(cast(event_id as varchar), '\d+')")),
    ("AT-4 category", bad("events", "event_type in ('view', 'click', 'purchase', 'signup')")),
    ("AT-5 tier", bad(E_SQL, "tier in (1, 2, 3, 4)")),
    ("AT-6 person", bad("events", "event_type in ('view', 'click', 'purchase', 'signup', 'error')")),
    ("AT-7 severity", bad("events", "value < 95")),
    ("AT-8 reportable", f"select count_if(v < 1) as n from (select count_if(reportable) as v from {E_SQL})"),
    ("AT-9 reportable are severe", bad(E_SQL, "not reportable or value > 90")),
    ("AT-10 times", bad(E_SQL, "coalesce(ts <= told, true) and coalesce(ts <= written, true) and coalesce(told <= written, true)")),
    ("AT-11 business hours", bad(E_SQL, "business_day = (weekday < 5)")),
    ("AT-12 no times", bad(E_SQL, "reportable or written is null")),
    ("AT-13 kinds not reportable", bad(E_SQL, "event_type not in ('view', 'click') or not reportable")),
    ("AT-14 centre", bad("events", "user_id >= 0")),
    ("AT-15 tier 4", bad(E_SQL, "tier <> 4 or value < 25.5")),
    ("AT-16 lower tiers", f"select count_if(not coalesce(v >= 0.4, false)) as n from (select avg(case when tier >= 3 then 1 else 0 end) as v from {E_SQL})"),
    ("AT-17 year", bad("events", "year(ts) = 2024")),
    ("AT-18 damage", bad("events", "value >= 0")),
)


@query("O7_safety_checks", SAFETY_SQL)
def safety_checks(t, spark):
    """Keys, domains, tiers, reportable incidents and the order of their times, business days and shares."""
    e = t("events").withColumns({
        "tier": 4 - F.floor(F.least("value", F.lit(99.99)) / 25).cast("int"),
        "reportable": (c("event_type") == "error") & (c("value") > 80),
        "told": F.expr("ts + interval 1 hour"),
        "written": F.when(c("event_type") == "error", F.expr("ts + interval 30 minute")),
        "weekday": F.weekday("ts"),
        "business_day": ~((F.weekday("ts") >= 5) | calendars.is_holiday(F.to_date("ts"))),
    })
    return checks.run_suite(safety(), {"events": e})
