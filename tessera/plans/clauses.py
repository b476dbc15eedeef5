"""Clause-level functions and joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import grammar as G
from tessera.functions import text as T
from tessera.operators import clauses as C
from tessera.operators import engine, joins, profiling, similar
from tessera.operators.stages import parts
from tessera.registry import query


@query("H27_reportability", "select event_id, value > 80 or event_type = 'error' as reportable, ts + interval 2 hour as due from events")
def reportability(t, spark):
    return t("events").select("event_id", ((F.col("value") > 80) | (F.col("event_type") == "error")).alias("reportable"), (F.col("ts") + F.expr("interval 2 hours")).alias("due"))


@query("H28_math", "select p_partkey, round(ln(p_retailprice), 4) as l, cast(greatest(round(p_size * 1.5), p_size + 1) as bigint) as m from part")
def math(t, spark):
    return t("part").select("p_partkey", F.round(F.ln("p_retailprice"), 4).alias("l"), F.greatest(F.round(F.col("p_size") * 1.5), F.col("p_size") + 1).cast("long").alias("m"))


@query("H32_humanised", "select distinct replace(lower(p_type), '_', ' ') as name from part")
def humanised(t, spark):
    return t("part").select(F.replace(F.lower("p_type"), F.lit("_"), F.lit(" ")).alias("name")).distinct()


@query("H34_value_source", "select l_returnflag, case l_returnflag when 'R' then 'company' when 'A' then 'law' else 'unknown' end as source, count(*) as n from lineitem group by 1, 2")
def value_source(t, spark):
    return t("lineitem").groupBy("l_returnflag", F.when(F.col("l_returnflag") == "R", "company").when(F.col("l_returnflag") == "A", "law").otherwise("unknown").alias("source")).agg(F.count("*").alias("n"))


@query("H36_codebook", "select 'l_returnflag' as column_name, string_agg(distinct l_returnflag, ',' order by l_returnflag) as codes from lineitem")
def codebook(t, spark):
    return t("lineitem").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("codes")).select(F.lit("l_returnflag").alias("column_name"), "codes")


@query("I6_line_diff")
def line_diff(t, spark):
    """Each document's lines beside those of the one before it in its source: neighbours by ids alone, then their texts."""
    d = t("documents")
    ids = d.select("doc_id", F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("before")).where("before is not null")
    both = ids.join(d.select("doc_id", "text"), "doc_id").join(d.select(F.col("doc_id").alias("before"), F.col("text").alias("old")), "before")
    return both.select("doc_id", "before", F.md5(G.line_diff("old", "text")).alias("digest"))


@query("I8_publication", "select o_orderkey, coalesce(case when o_orderstatus = 'F' then cast(o_orderdate as date) end, date '1990-01-01') as published, case when o_orderstatus = 'F' then 'effective' else 'default' end as basis from orders")
def publication(t, spark):
    done = F.col("o_orderstatus") == "F"
    return t("orders").select("o_orderkey", F.coalesce(F.when(done, F.to_date("o_orderdate")), F.lit("1990-01-01").cast("date")).alias("published"), F.when(done, "effective").otherwise("default").alias("basis"))


@query("I11_diff_hash", "select doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) as h from documents")
def diff_hash(t, spark):
    return t("documents").select("doc_id", F.sha2(T.squeeze(F.col("text")), 256).alias("h"))


@query("B8_eligible", "select doc_id from documents join labels using (doc_id) where quality = 1 and lang <> 'de'")
def eligible(t, spark):
    return t("documents").where("lang <> 'de'").select("doc_id").join(t("labels").where("quality = 1").select("doc_id"), "doc_id")


@query("B17_embeddable", "select doc_id from documents where trim(text) <> '' and not starts_with(text, 'Ti.') and length(text) >= 50")
def embeddable(t, spark):
    return t("documents").where((F.trim("text") != "") & ~F.col("text").startswith("Ti.") & (F.length("text") >= 50)).select("doc_id")


@query("B19_page_filter", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_returnflag in ('R', 'A') and l_linestatus = 'F' and l_discount > 0.08")
def page_filter(t, spark):
    shown = {"R": True, "A": True, "N": False}
    return t("lineitem").where(F.col("l_returnflag").isin([k for k, v in shown.items() if v]) & (F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.08)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("B22_board_filter", "select c_custkey from customer where case when lower(c_mktsegment) = 'machinery' then 'machines' else lower(c_mktsegment) end = 'machines' and c_acctbal > 5000")
def board_filter(t, spark):
    alias = F.create_map(F.lit("machinery"), F.lit("machines"))
    name = F.lower("c_mktsegment")
    return t("customer").where((F.coalesce(alias[name], name) == "machines") & (F.col("c_acctbal") > 5000)).select("c_custkey")


@query("C16_fragment_join", "select o.o_orderkey from orders o where exists (select 1 from customer c where regexp_extract(c.c_name, '([0-9]{4})$', 1) = lpad(cast(o.o_orderkey % 10000 as varchar), 4, '0') and c.c_nationkey = 3)")
def fragment_join(t, spark):
    c = t("customer").where("c_nationkey = 3").select(F.regexp_extract("c_name", r"([0-9]{4})$", 1).alias("f")).distinct()
    return t("orders").withColumn("f", F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).join(c, "f", "left_semi").select("o_orderkey")


@query("C21_open_items", "select o_orderkey, c_name, string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber, l_partkey) as lines from orders join customer on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P' group by 1, 2")
def open_items(t, spark):
    l = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    o = t("orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(l, "o_orderkey").join(t("customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name", F.array_join(F.transform("x", lambda i: i["l_linenumber"].cast("string")), ",").alias("lines"))


@query("C28_routing", "select o_orderkey, n_name as route_to from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey")
def routing(t, spark):
    c = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("route_to"))
    return t("orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").select("o_orderkey", "route_to")


@query("C31_restates", """with g as (select *, count(*) over (partition by p_type, p_size, p_brand) as n from part) select a.p_partkey as a, b.p_partkey as b from g a join g b on a.p_type = b.p_type and a.p_size = b.p_size and a.p_brand = b.p_brand and a.p_partkey < b.p_partkey where a.n <= 200""")
def restates(t, spark):
    """Pairs of one signature; signatures that more than 200 share say too little and are no evidence."""
    keys = ["p_type", "p_size", "p_brand"]
    g = t("part").select("p_partkey", *keys, F.count("*").over(Window.partitionBy(*keys)).alias("n")).where("n <= 200")
    return g.select(*keys, F.col("p_partkey").alias("a")).join(g.select(*keys, F.col("p_partkey").alias("b")), keys).where("a < b").select("a", "b")


#: Embeddings as the clauses of parts of the same number, ten to a document; what they cite are hundreds of orders, small parts cite none.
RESTATED = """c as (select vec_id as k, vec_id // 10 as doc, cast(embedding as double[]) as v, p_size <= 15 as bare, p_brand, p_size from embeddings join part on p_partkey = vec_id),
sec as (select distinct l_partkey as k, l_orderkey // 10 as s from lineitem join c on k = l_partkey where not bare), sig as (select k, p_brand as sig from c union all select k, 'size ' || p_size from c),
ok as (select sig from sig group by 1 having count(*) <= 200), li as (select k as a, k + 1 as b from c where p_size > 40)"""


@query("C31_restates_by_cosine", f"""with {RESTATED}, p as (select a.k as a, b.k as b, min(a.sig) as sig from sig a join sig b using (sig) join ok using (sig) join c x on x.k = a.k join c y on y.k = b.k where a.k < b.k and (exists (select 1 from sec s join sec t on s.s = t.s where s.k = a.k and t.k = b.k)
or (((x.bare or not exists (select 1 from sec where sec.k = a.k)) or (y.bare or not exists (select 1 from sec where sec.k = b.k))) and (x.doc = y.doc or exists (select 1 from li where li.a = a.k and li.b = b.k)))) group by 1, 2),
d as (select a, b, sig, list_cosine_similarity(x.v, y.v) as score from p join c x on x.k = a join c y on y.k = b) select a as from_id, b as to_id, round(score, 6) as score, sig as signature from d where score >= 0.1 union all select b, a, round(score, 6), sig from d where score >= 0.1""")
def restates_by_cosine(t, spark):
    """Clauses with one parameter, in one section, document or link, whose vectors are alike."""
    c = t("embeddings").join(t("part"), F.col("vec_id") == F.col("p_partkey")).select(F.col("vec_id").alias("clause_id"), "p_brand", "p_size", "embedding")
    cited = t("lineitem").select(F.col("l_partkey").alias("clause_id"), F.expr("l_orderkey div 10").alias("s")).groupBy("clause_id").agg(F.collect_set("s").alias("cited"))
    none = F.array().cast("array<bigint>")
    clauses = c.join(cited, "clause_id", "left").select("clause_id", F.expr("clause_id div 10").alias("doc_id"), F.when(F.col("p_size") <= 15, none).otherwise(F.coalesce("cited", none)).alias("sections"), F.col("embedding").alias("vec"))
    params = c.select("clause_id", F.explode(F.array("p_brand", F.concat(F.lit("size "), F.col("p_size").cast("string")))).alias("signature"))
    links = c.where("p_size > 40").select(F.col("clause_id").alias("from_id"), (F.col("clause_id") + 1).alias("to_id"))
    found = similar.restates(clauses, params, links, least=0.1)
    return found.select("from_id", "to_id", F.round("score", 6).alias("score"), "signature")


@query("C35_reference_columns", "select 'l_orderkey' as column_name, round(count_if(regexp_matches(cast(l_orderkey as varchar), '^[0-9]+$')) / count(*), 6) as shaped, round(count(o_orderkey) / count(*), 6) as known from lineitem left join orders on o_orderkey = l_orderkey")
def reference_columns(t, spark):
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("hit"))
    df = t("lineitem").select("l_orderkey").join(o, "l_orderkey", "left")
    return df.agg(F.round(F.count_if(F.col("l_orderkey").cast("string").rlike("^[0-9]+$")) / F.count("*"), 6).alias("shaped"), F.round(F.count("hit") / F.count("*"), 6).alias("known")).select(F.lit("l_orderkey").alias("column_name"), "shaped", "known")


@query("C36_rule_documents", "select coalesce(case when l_suppkey % 2 = 0 then 's' || l_suppkey end, 'p' || l_partkey % 50) as rule, count(distinct l_orderkey) as n_docs from lineitem group by 1")
def rule_documents(t, spark):
    rule = F.coalesce(F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")))
    return t("lineitem").groupBy(rule.alias("rule")).agg(F.countDistinct("l_orderkey").alias("n_docs"))


@query("C37_coalesced_key", "select o_orderkey, c_name from orders left join customer on c_custkey = coalesce(nullif(o_custkey, 7), 8)")
def coalesced_key(t, spark):
    return t("orders").withColumn("c_custkey", F.coalesce(F.nullif("o_custkey", F.lit(7)), F.lit(8))).join(t("customer").select("c_custkey", "c_name"), "c_custkey", "left").select("o_orderkey", "c_name")


@query("E2_distinct_on", "select distinct on (l_suppkey) l_suppkey, l_orderkey, l_linenumber from lineitem order by l_suppkey, l_shipdate desc, l_orderkey desc, l_linenumber desc, l_partkey desc")
def distinct_on(t, spark):
    return joins.latest_per_key(t("lineitem"), ["l_suppkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_partkey")]).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("E1_most_recent", "select user_id, arg_max(event_type, (ts, event_id)) as last_type from events group by user_id")
def most_recent(t, spark):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("E12_presets", """with c as (select l_suppkey, l_partkey, count(distinct l_orderkey) n from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by n desc, l_partkey) i from c) select l_suppkey, l_partkey, n from r where i = 1 order by n desc, l_suppkey limit 3""")
def presets(t, spark):
    c = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.countDistinct("l_orderkey").alias("n"))
    return joins.latest_per_key(c, ["l_suppkey"], [F.desc("n"), F.asc("l_partkey")]).orderBy(F.desc("n"), "l_suppkey").limit(3).select("l_suppkey", "l_partkey", "n")


@query("E17_leftmost_longest", "select doc_id, len(regexp_extract_all(text, 'the[a-z]+|the|an')) as n from documents")
def leftmost_longest(t, spark):
    return t("documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("the[a-z]+|the|an"), F.lit(0))).cast("long").alias("n"))


@query("G7_annotations", "select o_orderkey, 'finding' as kind from orders where o_totalprice > 450000 union all select o_orderkey, 'cleared' from orders where o_totalprice < 2000")
def annotations(t, spark):
    o = t("orders")
    return o.where("o_totalprice > 450000").select("o_orderkey", F.lit("finding").alias("kind")).unionByName(o.where("o_totalprice < 2000").select("o_orderkey", F.lit("cleared").alias("kind")))


@query("F11_capped_list", "select l_orderkey, l_partkey, l_linenumber from lineitem order by l_returnflag = 'R' desc, l_orderkey, l_linenumber, l_partkey limit 25")
def capped_list(t, spark):
    return t("lineitem").orderBy((F.col("l_returnflag") == "R").desc(), "l_orderkey", "l_linenumber", "l_partkey").limit(25).select("l_orderkey", "l_partkey", "l_linenumber")


@query("J1_breadcrumb_chunks", """with w as (select doc_id, source, len(list_filter(string_split(text, ' '), lambda x: x <> '')) as n from documents) select doc_id, cast(i as integer) as chunk, source || ' > ' || cast(i as varchar) as crumb from (select doc_id, source, unnest(generate_series(0, cast(greatest(ceil((n - 500) / 450), 0) as bigint))) as i from w where n > 0)""")
def breadcrumb_chunks(t, spark):
    words = F.filter(F.split("text", " "), lambda x: x != "")
    return t("documents").select("doc_id", "source", F.explode(T.chunks(words)).alias("c")).select("doc_id", "c.chunk", F.concat("source", F.lit(" > "), F.col("c.chunk").cast("string")).alias("crumb"))


@query("J3_filtered_topk", """with q as (select embedding::double[] as v from embeddings where vec_id = 3) select vec_id, round(list_cosine_similarity(e.embedding::double[], q.v), 6) as score from embeddings e, q where label in (1, 2) and vec_id <> 3 order by score desc, vec_id limit 10""")
def filtered_topk(t, spark):
    e = t("embeddings")
    q = F.broadcast(e.where("vec_id = 3").select(F.col("embedding").alias("v")))
    return e.where("label in (1, 2) and vec_id <> 3").join(q).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("v")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("J2_hashed_embedding")
def hashed_embedding(t, spark):
    """A stand-in for a model: signed sums of word hashes in 64 dimensions, of length 1."""
    words = F.transform(F.array_distinct(F.split(F.lower("text"), r"\s+")), lambda x: F.xxhash64(x))
    v = t("documents").select("doc_id", T.signed_sums(words).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("doc_id", F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("embedding"))


@query("N1_neighbours", "with e as (select distinct l_suppkey a, l_partkey % 20 + 1000 b from lineitem) select a as node, b as other from e where a <> b union select b, a from e where a <> b")
def neighbours(t, spark):
    """Every node's neighbours, in both directions."""
    e = t("lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 20 + 1000).alias("b"))
    return joins.neighbours(e, "a", "b")


@query("N2_typed_neighbours", "select a.l_suppkey as node, b.l_returnflag as type, count(distinct b.l_suppkey) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey <> b.l_suppkey group by 1, 2")
def typed_neighbours(t, spark):
    """How many others share an order with each supplier, by the type of their line."""
    # dealt by order once, then by pair, in parts of so many lines, so that a task's memory doesn't grow with the table
    n = parts(t("lineitem"), 500_000)
    l = t("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").repartition(n, "l_orderkey").distinct()
    own = l.select("l_orderkey", F.col("l_suppkey").alias("node")).distinct()
    pairs = own.join(l, "l_orderkey").where("node <> l_suppkey").select("node", F.col("l_returnflag").alias("type"), "l_suppkey").repartition(n, "node", "type", "l_suppkey").distinct()
    return pairs.groupBy("node", "type").agg(F.count("*").alias("n"))


@query("L10_cache_misses", "select count(distinct o_orderpriority || o_orderstatus) as n_prompts, count(distinct case when o_orderstatus = 'F' then null else o_orderpriority || o_orderstatus end) as n_misses from orders")
def cache_misses(t, spark):
    p = t("orders").select(F.concat("o_orderpriority", "o_orderstatus").alias("p"), "o_orderstatus").dropDuplicates(["p"])
    cache = p.where("o_orderstatus = 'F'").select("p")
    return p.agg(F.count("*").alias("n_prompts")).join(F.broadcast(p.join(cache, "p", "left_anti").agg(F.count("*").alias("n_misses"))))


@query("A10_first_substring", "select p_partkey, case when contains(p_name, 'red') then 'red' when contains(p_name, 'small') then 'small' else '' end as kind from part")
def first_substring(t, spark):
    return t("part").select("p_partkey", F.when(F.col("p_name").contains("red"), "red").when(F.col("p_name").contains("small"), "small").otherwise("").alias("kind"))


@query("A13_cursor", "select o_orderstatus, cast(max(o_orderdate) as date) + 1 as cursor from orders group by 1")
def cursor(t, spark):
    return t("orders").groupBy("o_orderstatus").agg(F.date_add(F.max("o_orderdate").cast("date"), 1).alias("cursor"))


@query("A20_fallback", "select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), n_name) as owner, c_mktsegment is distinct from n_name as apart from customer join nation on n_nationkey = c_nationkey")
def fallback(t, spark):
    n = F.broadcast(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    return t("customer").join(n, "c_nationkey").select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), "n_name").alias("owner"), (~F.col("c_mktsegment").eqNullSafe(F.col("n_name"))).alias("apart"))


@query("A28_named_view", "select count(*) as n from orders")
def named_view(t, spark):
    return spark.sql("select count(*) as n from {orders}", orders=t("orders"))


@query("A25_chunk_points", """with w as (select doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) as n from documents) select doc_id * 1000 + i as point_id from (select doc_id, unnest(generate_series(0, cast(greatest(ceil((n - 500) / 450), 0) as bigint))) as i from w where n > 0)""")
def chunk_points(t, spark):
    words = F.filter(F.split("text", " "), lambda x: x != "")
    return t("documents").select("doc_id", F.explode(T.chunks(words)).alias("c")).select((F.col("doc_id") * 1000 + F.col("c.chunk")).alias("point_id"))


@query("D15_scope_rollup", "select level, key, count(distinct l_orderkey) as n from (select 'supplier' as level, cast(l_suppkey as varchar) as key, l_orderkey from lineitem union all select 'nation', cast(s_nationkey as varchar), l_orderkey from lineitem join supplier on s_suppkey = l_suppkey) group by 1, 2")
def scope_rollup(t, spark):
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    both = F.explode(F.array(F.struct(F.lit("supplier").alias("level"), F.col("l_suppkey").cast("string").alias("key")), F.struct(F.lit("nation").alias("level"), F.col("s_nationkey").cast("string").alias("key"))))
    return t("lineitem").select("l_orderkey", "l_suppkey").join(s, "l_suppkey").select("l_orderkey", both.alias("x")).groupBy("x.level", "x.key").agg(F.countDistinct("l_orderkey").alias("n"))


@query("D18_agreement", "select round(avg(case when quality = 1 and toxic = 0 then 100.0 else 0.0 end), 6) as pct from labels")
def agreement(t, spark):
    return t("labels").agg(F.round(F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 100.0).otherwise(0.0)), 6).alias("pct"))


@query("D22_value_multisets", "select p_type, p_size from part where p_brand = 'Brand#1' except all select p_type, p_size from part where p_brand = 'Brand#2'")
def value_multisets(t, spark):
    p = t("part")
    return p.where("p_brand = 'Brand#1'").select("p_type", "p_size").exceptAll(p.where("p_brand = 'Brand#2'").select("p_type", "p_size"))


@query("D31_sample_within_group", "select c_nationkey, count_if(c_custkey % 10 = 0) as n_sample, count(*) as n_all, count_if(c_custkey % 10 = 0) <= count(*) as holds from customer group by 1")
def sample_within_group(t, spark):
    n = F.count_if(F.col("c_custkey") % 10 == 0)
    return t("customer").groupBy("c_nationkey").agg(n.alias("n_sample"), F.count("*").alias("n_all"), (n <= F.count("*")).alias("holds"))


@query("D35_version_choice", "select o_custkey, count(*) as n, bool_or(o_orderstatus = 'F') as has_final, max(case when o_orderstatus = 'F' then o_orderkey end) as chosen from orders group by 1")
def version_choice(t, spark):
    final = F.col("o_orderstatus") == "F"
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(final).alias("has_final"), F.max(F.when(final, F.col("o_orderkey"))).alias("chosen"))


@query("D37_grouped_counts", "select n_name, count_if(c_acctbal < 0) as negative, count_if(c_acctbal >= 0) as positive from customer join nation on n_nationkey = c_nationkey group by 1")
def grouped_counts(t, spark):
    n = F.broadcast(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    return t("customer").join(n, "c_nationkey").groupBy("n_name").agg(F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_if(F.col("c_acctbal") >= 0).alias("positive"))


@query("K3_first_events", "select count(*) as n from (select distinct user_id, event_type, cast(ts as date) from events)")
def first_events(t, spark):
    return t("events").select("user_id", "event_type", F.to_date("ts").alias("d")).distinct().agg(F.count("*").alias("n"))


@query("K6_stale", "select user_id, max(ts) < timestamp '2024-01-20 00:00:00' as is_stale from events group by 1")
def stale(t, spark):
    return t("events").groupBy("user_id").agg((F.max("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).alias("is_stale"))


@query("O5_notice_days", "select count_if(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) < 14) as n_short, count(*) as n from lineitem join orders on o_orderkey = l_orderkey where l_shipdate >= o_orderdate")
def notice_days(t, spark):
    l = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").join(t("orders").select("o_orderkey", "o_orderdate"), "o_orderkey").where("l_shipdate >= o_orderdate")
    return l.agg(F.count_if(F.datediff("l_shipdate", "o_orderdate") < 14).alias("n_short"), F.count("*").alias("n"))


@query("O6_domains", "select 'status' as check_name, count_if(o_orderstatus not in ('F', 'O', 'P')) as n_violations, count_if(o_orderstatus not in ('F', 'O', 'P')) = 0 as passed from orders union all select 'price', count_if(o_totalprice <= 0), count_if(o_totalprice <= 0) = 0 from orders")
def domains(t, spark):
    o = t("orders")
    return profiling.assert_empty("status", o.where(~F.col("o_orderstatus").isin("F", "O", "P"))).unionByName(profiling.assert_empty("price", o.where("o_totalprice <= 0")))


@query("O8_recomputed_flag", "select count_if((l_quantity <= 25) <> (l_quantity < 25.5)) as n_apart from lineitem")
def recomputed_flag(t, spark):
    return t("lineitem").agg(F.count_if((F.col("l_quantity") <= 25) != (F.col("l_quantity") < 25.5)).alias("n_apart"))


@query("O3_within_tolerance", "select abs(sum(value) - round(sum(value), 2)) < 0.01 as passed, count(distinct cast(ts as date)) as n_days from events")
def within_tolerance(t, spark):
    return t("events").agg((F.abs(F.sum("value") - F.round(F.sum("value"), 2)) < 0.01).alias("passed"), F.countDistinct(F.to_date("ts")).alias("n_days"))


@query("O9_leaks", """with g as (select item_id, string_split(lower(text), ' ') w from benchmark), s as (select distinct array_to_string(w[i:i + 5], ' ') as g from (select w, unnest(generate_series(1, len(w) - 5)) i from g where len(w) >= 6)), d as (select doc_id, string_split(lower(text), ' ') w from documents), x as (select distinct doc_id, array_to_string(w[i:i + 5], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 5)) i from d where len(w) >= 6))
select doc_id, count(*) as n from x where g in (select g from s) group by 1 having count(*) >= 3""")
def leaks(t, spark):
    """Documents that share three or more six-word runs with the benchmark, by their hashes."""

    def runs(df, *key):
        w = df.select(*key, F.split(F.lower("text"), " ").alias("w")).where("size(w) >= 6")
        return w.select(*key, F.explode(T.shingles(F.col("w"), 6, hashed=True)).alias("g"))

    return runs(t("documents"), "doc_id").join(runs(t("benchmark")).distinct(), "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 3")


#: Parts as clauses of documents of forty: numbered sections, rules, rows of registers, forms and definitions; what they say is one of thirteen wordings around the part's name.
K, N = "p_partkey", "(p_partkey % 40)"
UNIT_FIELDS = {
    "doc_id": f"concat('ACM-CS-PRO-', cast({K} div 40 as string))",
    "local_id": f"case when {N} < 25 then cast({N} + 1 as string) when {N} < 30 then concat('R', cast({N} as string), '.1') when {N} < 33 then concat('OBL-', lpad(cast({K} % 5000 as string), 4, '0'), '-', lpad(cast({N} as string), 4, '0')) when {N} < 36 then concat('RRS-AB-', lpad(cast({K} % 700 as string), 3, '0')) else concat('App-A.F', cast({N} as string)) end",
    "unit_kind": f"case when {N} < 25 then 'section' when {N} < 30 then 'tariff_subrule' when {N} < 36 then 'register_row' else 'form_field' end",
    "section_kind": "case p_size % 7 when 0 then 'definitions' when 1 then 'approval' when 2 then 'front_matter' else 'procedure' end",
    "heading": f"case when {N} >= 36 then concat('Form CS-F-', lpad(cast({K} % 600 as string), 3, '0')) when p_size % 7 = 0 then concat('Defined ', p_type, 's') else 'What is done here' end",
    "sheet_no": f"case when {N} between 25 and 29 then cast({K} % 300 as string) end",
    "n_citations": "p_size % 3",
    "cells": f"case when {N} between 30 and 35 then concat('Rule 2', cast({K} % 10 as string), '; CS-F-', lpad(cast({K} % 600 as string), 3, '0'), ', ACM-CS-PRO-', cast({K} div 80 as string), ' ;; ', p_name) end",
    "text_raw": f"""case p_size % 13
        when 0 then concat('For ', p_name, ' see ACM-CS-PRO-', cast({K} div 80 as string), ', which says more.')
        when 1 then concat('As ACM-CS-PRO-', cast({K} div 80 as string), ':', cast({K} % 25 + 1 as string), ' says, ', p_name, ' stay.')
        when 2 then concat('Under §', cast({K} % 30 + 1 as string), ' of this, ', p_name)
        when 3 then concat(p_name, ' are on Sheet No. ', cast({K} % 320 as string))
        when 4 then concat('Sheets Nos. ', cast({K} % 300 as string), '-', cast({K} % 300 + 3 as string), ' hold ', p_name)
        when 5 then concat('Rule ', cast({K} % 8 + 24 as string), ' of the tariff: ', p_name)
        when 6 then concat('File form CS-F-', lpad(cast({K} * 7 % 650 as string), 3, '0'), ' for ', p_name)
        when 7 then concat('Keep ', p_name, ' by RRS-AB-', lpad(cast({K} * 3 % 700 as string), 3, '0'), '.')
        when 8 then concat('OBL-', lpad(cast({K} * 3 % 5000 as string), 4, '0'), '-', lpad(cast({K} % 3 + 30 as string), 4, '0'), ' binds ', p_name)
        when 9 then concat('Internal performance target: ', p_name)
        when 10 then concat('Company position: ', p_name, ', ACM-XX-PRO-1 and Rules 9')
        when 11 then concat('**', p_name, 's** means what §1 says')
        else concat('"', p_name, '" is plain') end""",
}


def duck(expression: str) -> str:
    return expression.replace(" div ", " // ").replace("as string)", "as varchar)")


UNITS = f"""u0 as (select p_partkey as k, p_name, p_type, p_size, p_partkey % 40 as m, {", ".join(f"{duck(e)} as {n}" for n, e in UNIT_FIELDS.items())} from part), u as (select *, doc_id || ':' || local_id as clause_id from u0)"""
#: What each wording refers to, in SQL by itself: (type, target) by the wording's number, and the parts of list cells.
REFERRED = """r as (select clause_id, doc_id, unit_kind, k, 0 as n, 'references_doc' as t, 'ACM-CS-PRO-' || k // 80 as x from u where p_size % 13 in (0, 1)
union all select clause_id, doc_id, unit_kind, k, 1, 'references_clause', 'ACM-CS-PRO-' || k // 80 || ':' || (k % 25 + 1) from u where p_size % 13 = 1
union all select clause_id, doc_id, unit_kind, k, 1, 'references_clause', doc_id || ':' || (k % 30 + 1) from u where p_size % 13 = 2
union all select clause_id, doc_id, unit_kind, k, 1, 'references_clause', doc_id || ':1' from u where p_size % 13 = 11
union all select clause_id, doc_id, unit_kind, k, 1, 'references_tariff', 'sheet:' || k % 320 from u where p_size % 13 = 3
union all select clause_id, doc_id, unit_kind, k, 1, 'references_tariff', 'sheet:' || k % 300 || '-' || (k % 300 + 3) from u where p_size % 13 = 4
union all select clause_id, doc_id, unit_kind, k, 1, 'references_tariff', 'rule:' || (k % 8 + 24) from u where p_size % 13 = 5
union all select clause_id, doc_id, unit_kind, k, 1, 'references_form', 'CS-F-' || lpad((k * 7 % 650)::varchar, 3, '0') from u where p_size % 13 = 6
union all select clause_id, doc_id, unit_kind, k, 1, 'references_record_series', 'RRS-AB-' || lpad((k * 3 % 700)::varchar, 3, '0') from u where p_size % 13 = 7
union all select clause_id, doc_id, unit_kind, k, 1, 'references_obligation', 'OBL-' || lpad((k * 3 % 5000)::varchar, 4, '0') || '-' || lpad((k % 3 + 30)::varchar, 4, '0') from u where p_size % 13 = 8
union all select clause_id, doc_id, unit_kind, k, 2, 'references_tariff', 'rule:2' || k % 10 from u where m between 30 and 35
union all select clause_id, doc_id, unit_kind, k, 3, 'references_form', 'CS-F-' || lpad((k % 600)::varchar, 3, '0') from u where m between 30 and 35
union all select clause_id, doc_id, unit_kind, k, 4, 'references_doc', 'ACM-CS-PRO-' || k // 80 from u where m between 30 and 35
union all select clause_id, doc_id, unit_kind, k, 5, 'references_doc', p_name from u where m between 30 and 35),
refs as (select clause_id, doc_id, unit_kind, t as ref_type, x as target, min(n) as n from r group by all)"""


def company_units(t):
    df = t("part").select("p_partkey", *[F.expr(e).alias(n) for n, e in UNIT_FIELDS.items()])
    cells = F.when(F.col("cells").isNotNull(), F.create_map(F.lit("reference_list"), F.col("cells"))).otherwise(F.lit(None).cast("map<string,string>"))
    return df.select("doc_id", "local_id", F.concat_ws(":", "doc_id", "local_id").alias("clause_id"), F.col("p_partkey").alias("ordinal"), "unit_kind", "section_kind", F.array("heading").alias("heading_path"), "text_raw", cells.alias("row_cells"), "sheet_no", "n_citations")


def company_references(t):
    units = company_units(t)
    registered = units.select("doc_id").distinct()
    return units, registered, C.references(units, registered)


@query("H16_found_references", f"with {UNITS}, {REFERRED} select clause_id, ref_type, target from refs")
def found_references(t, spark):
    """What clauses of thirteen wordings, and list cells of registers, refer to."""
    return company_references(t)[2].select("clause_id", "ref_type", "target")


@query("C30_resolved_references", rf"""with {UNITS}, {REFERRED}, e as (select refs.*, case when target like 'sheet:%-%' then 'sheet:' || i else target end as asked from refs, unnest(case when target like 'sheet:%-%' then generate_series(cast(regexp_extract(target, '(\d+)-', 1) as int), cast(regexp_extract(target, '-(\d+)', 1) as int)) else [0] end) v(i)),
x as (select 'references_doc' as t, doc_id as y, null as c, doc_id as d from (select distinct doc_id from u) union all select 'references_clause', clause_id, clause_id, null from u union all select 'references_tariff', 'sheet:' || sheet_no, clause_id, null from u where sheet_no is not null
union all select 'references_tariff', 'rule:' || m, clause_id, null from u where m between 25 and 29 union all select 'references_form', f, arg_min(clause_id, (doc_id, k)), null from (select *, regexp_extract(case when m >= 36 then heading when p_size % 13 = 6 then text_raw end, 'CS-F-[0-9]+') as f from u where m >= 36 or p_size % 13 = 6) group by f
union all select case when m < 33 then 'references_obligation' else 'references_record_series' end, local_id, arg_max(clause_id, (doc_id, k)), null from u where m between 30 and 35 group by 1, 2),
h as (select e.*, c, d from e join x on t = ref_type and y = asked), b as (select clause_id, ref_type, target, c, d from h qualify row_number() over (partition by clause_id, ref_type, c order by n, asked, d) = 1)
select clause_id, ref_type, target, c as to_clause_id, d as to_doc_id from b union all select clause_id, ref_type, target, null, null from refs where not exists (select 1 from h where h.clause_id = refs.clause_id and h.ref_type = refs.ref_type and h.target = refs.target)""")
def resolved_references(t, spark):
    """References of all seven kinds with the clauses or documents that they mean; the others with none."""
    units, registered, refs = company_references(t)
    return C.resolved(refs, C.targets(units, registered)).select("clause_id", "ref_type", "target", "to_clause_id", "to_doc_id")


@query("H17_ordered_roles", f"""with {UNITS} select clause_id, role, case when section_kind in ('approval') then false when role = 'boilerplate' then false else true end as assessable from (select *, case when p_size % 13 = 9 then 'internal_target' when p_size % 13 = 10 then 'company_position' when m >= 36 then 'template_field' when section_kind = 'definitions' or p_size % 13 = 11 then 'definition' when section_kind in ('approval', 'front_matter') then 'boilerplate' when m between 30 and 35 then case when n_citations > 0 then 'regulatory_restatement' else 'internal_procedure' end end as role from u)""")
def ordered_roles(t, spark):
    """The first of seven rules that holds for a clause."""
    return C.role(company_units(t)).select("clause_id", "role", "assessable")


@query("H19_terms", f"""with {UNITS}, d as (select *, case when p_size % 13 = 11 then p_name || 's' when p_size % 13 = 12 then p_name when section_kind = 'definitions' and (m >= 36 or p_size % 7 = 0) then heading end as term from u where section_kind = 'definitions' or (p_size % 13 = 11 and m < 36))
select clause_id as definition_clause_id, term, case when term like '%ss' or not term like '%s' then lower(term) else lower(term[:-2]) end as term_norm, n_citations > 0 as cites_regulatory_definition from d where term is not null""")
def found_terms(t, spark):
    """Terms that clauses define: bold, quoted, or by the heading alone."""
    return C.terms(C.role(company_units(t))).select("definition_clause_id", "term", "term_norm", "cites_regulatory_definition")


#: The rules of roles in SQL.
ROLE = "case when p_size % 13 = 9 then 'internal_target' when p_size % 13 = 10 then 'company_position' when m >= 36 then 'template_field' when section_kind = 'definitions' or p_size % 13 = 11 then 'definition' when section_kind in ('approval', 'front_matter') then 'boilerplate' when m between 30 and 35 then case when n_citations > 0 then 'regulatory_restatement' else 'internal_procedure' end end"


@query("C4_assessable_clauses", f"""with {UNITS}, r as (select *, {ROLE} as role from u), e as (select * from r where section_kind <> 'approval' and (role is null or role <> 'boilerplate')), d as (select doc_id, count(*) as n, min(heading) as title from u group by 1) select clause_id, doc_id, title, n as n_clauses from e join d using (doc_id)""")
def assessable_clauses(t, spark):
    """Clauses that can be assessed, with their documents."""
    units = company_units(t)
    docs = units.groupBy("doc_id").agg(F.count("*").alias("n_clauses"), F.min(F.get("heading_path", 0)).alias("title"))
    return C.role(units).where("assessable").join(docs, "doc_id").select("clause_id", "doc_id", "title", "n_clauses")


@query("D18_role_agreement", f"""with {UNITS}, r as (select *, {ROLE} as got, case when m >= 36 then 'template_field' when section_kind = 'definitions' then 'definition' when p_size % 13 = 10 then 'company_position' when section_kind = 'approval' then 'boilerplate' else 'none' end as want from u)
select want, count(*) as n, count_if(coalesce(got, 'none') = want) as n_agree, round(count_if(coalesce(got, 'none') = want) / count(*), 6) as share, count(distinct case when coalesce(got, 'none') <> want then coalesce(got, 'none') end) as n_kinds_missed from r group by 1""")
def role_agreement(t, spark):
    """Roles by the rules beside a reader's, by what the reader says: how many agree, and how many other roles were given."""
    section, kind = F.col("section_kind"), F.col("unit_kind")
    want = F.when(kind == "form_field", "template_field").when(section == "definitions", "definition").when(F.col("text_raw").startswith("Company position"), "company_position").when(section == "approval", "boilerplate").otherwise("none")
    df = C.role(company_units(t)).select(want.alias("want"), F.coalesce("role", F.lit("none")).alias("got"))
    agree = F.col("want") == F.col("got")
    return df.groupBy("want").agg(F.count("*").alias("n"), F.count_if(agree).alias("n_agree"), F.round(F.count_if(agree) / F.count("*"), 6).alias("share"), F.count_distinct(F.when(~agree, F.col("got"))).alias("n_kinds_missed"))
