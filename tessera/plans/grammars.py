"""Citation, quantity and wording grammars over texts that are written out for every order or part, so that SQL knows what stands in them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tessera.functions import grammar as G
from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import engine, joins, profiling, scoring
from tessera.operators.stages import spread
from tessera.registry import query

#: Numbers of each order that its texts name, for Spark and the oracle.
NUMBERS = {"k": "o_orderkey", "a": "o_custkey % 300 + 1", "b": "o_orderkey % 20 + 1", "c": "o_orderkey % 7 + 1", "d": "o_orderkey % 30 + 1", "f": "o_orderkey % 50 + 1", "p": "o_custkey % 400 + 1", "s": "o_orderkey % 90 + 1"}
O = "(select " + ", ".join(f"{v} as {n}" for n, v in NUMBERS.items()) + ", o_orderstatus as st, cast(o_orderdate as date) as day from orders) o"
IAC, CFR = "format('{} IAC {}-{}-{}', a, b, c, d)", "format('{} CFR {}.{}', f, p, s)"
BASE = "The utility shall file report {} with the commission within 30 days after the end of each quarter."


def orders(t):
    return t("orders").select(*[F.expr(v).cast("long").alias(n) for n, v in NUMBERS.items()], F.col("o_orderstatus").alias("st"), F.to_date("o_orderdate").alias("day"))


def written(t, form, *numbers):
    """Orders with a text in which numbers are filled in."""
    return orders(t).withColumn("text", F.format_string(form, *numbers))


def by_status(**texts):
    """One of three forms by the order's status, with its key filled in."""
    return F.when(F.col("st") == "F", F.format_string(texts["F"], "k")).when(F.col("st") == "O", F.format_string(texts["O"], "k")).otherwise(F.format_string(texts["P"], "k"))


def cited(t):
    return written(t, "See %d IAC %d-%d-%d and %d CFR %d.%d today", "a", "b", "c", "d", "f", "p", "s")


@query("H7_citations", f"select k, {IAC} as citation, format('{{}} IAC {{}}-{{}}', a, b, c) as rule_key from {O} union all select k, {CFR}, format('{{}} CFR {{}}', f, p) from {O}")
def citations(t, spark):
    return cited(t).select("k", F.explode(G.citations("text")).alias("c")).select("k", "c.citation", "c.rule_key")


@query("H7_citation_ranges", f"select k, format('{{}} IAC {{}}-{{}}-{{}}', a, b, c, d + i) as citation from (select *, unnest(generate_series(0, 3)) as i from {O}) union all select k, format('NFPA {{}}', p) from {O} union all select k, format('ISO {{}}', a) from {O}")
def citation_ranges(t, spark):
    """Ranges of sections are one citation each; standards are named by their body."""
    df = written(t, "[%d IAC %d-%d-%d through %d IAC %d-%d-%d], NFPA %d and ISO %d", "a", "b", "c", "d", "a", "b", "c", F.col("d") + 3, "p", "a")
    return df.select("k", F.explode(G.citations("text")).alias("c")).select("k", "c.citation")


@query("H8_citation_spans", f"select k, 4 as start, 4 + length({IAC}) as stop from {O} union all select k, 9 + length({IAC}), 9 + length({IAC}) + length({CFR}) from {O}")
def citation_spans(t, spark):
    return cited(t).select("k", F.explode(G.citations("text")).alias("c")).select("k", F.col("c.start").cast("long").alias("start"), F.col("c.stop").cast("long").alias("stop"))


@query("H11_parameters", f"select k, 'period' as kind, cast(s as double) as value_num, 'day' as unit, 'business' as day_type from {O} union all select k, 'amount', cast(a as double), 'dollar', null from {O} union all select k, 'percentage', cast(d as double), 'percent', null from {O} union all select k, 'frequency', null, 'annually', null from {O}")
def parameters(t, spark):
    df = written(t, "File within %d business days under %d IAC %d-%d-%d, or pay $%d or %d%% of dues, reported annually.", "s", "a", "b", "c", "d", "a", "d")
    return spread(df.select("k", "text")).select("k", F.explode(G.parameters("text")).alias("p")).select("k", "p.kind", "p.value_num", "p.unit", "p.day_type")


#: Sentences with a number n (1 to 90) and what they say: kind, value, unit, kind of day, qualifier.
SENTENCES = (
    ("The utility shall respond within {n} business days.", "period", "n", "day", "business", "within"),
    ("A {n}-day notice period applies", "period", "n", "day", None, None),
    ("Pay a fee of ${n}.00 at once", "amount", "n", "dollar", None, None),
    ("It covers {n},500 customers; that is all.", "number", "n * 1000 + 500", "customer", None, None),
    ("File it no later than {n} days after", "deadline", "n", "day", None, "not_more_than"),
    ("Give at least {n} hours of notice", "period", "n", "hour", None, "at_least"),
    ("Retain the records for {n} years.", "record_retention", "n", "year", None, None),
    ("Spills of {n} gallons or more are told", "threshold", "n", "gallon", None, None),
    ("Inspect every {n} days", "frequency", "n", "day", None, None),
    ("Not more than {n} percent may be lost", "threshold", "n", "percent", None, "not_more_than"),
    ("The report is due within {n} calendar days", "deadline", "n", "day", "calendar", "within"),
    ("Lines of not less than {n} kV count", "threshold", "n", "kv", None, "at_least"),
    ("Come prior to {n} minutes; keep nothing", "period", "n", "minute", None, "prior_to"),
    ("exactly {n} working days, 170 IAC 4-1-{n} says", "period", "n", "day", "working", "exactly"),
    ("Call 555-{n}12 about form CS-F-{n}1 and sheet {n}", None, None, None, None, None),
    ("After {n} months it exceeds the rest", "threshold", "n", "month", None, "after"),
)


def quantity_sql() -> str:
    said = lambda x: "null" if x is None else f"'{x}'"
    rows = [f"select k, {said(kind)} as kind, cast({value} as double) as value_num, {said(unit)} as unit, {said(day)} as day_type, {said(what)} as qualifier from (select o_orderkey as k, o_custkey % 90 + 1 as n from orders where o_orderkey % {len(SENTENCES)} = {i}) q" for i, (_, kind, value, unit, day, what) in enumerate(SENTENCES) if kind]
    return " union all ".join(rows)


@query("H11_quantities", quantity_sql())
def sentence_quantities(t, spark):
    """Quantities of sixteen kinds of sentences, with what qualifies them and what the sentence makes of them."""
    n = (F.col("o_custkey") % 90 + 1).cast("string")
    text = F.lit(None).cast("string")
    for i, (form, *_) in enumerate(SENTENCES):
        parts = [p for k, x in enumerate(form.split("{n}")) for p in ((n, F.lit(x)) if k else (F.lit(x),))]
        text = F.when(F.col("o_orderkey") % len(SENTENCES) == i, F.concat(*parts)).otherwise(text)
    df = spread(t("orders").select(F.col("o_orderkey").alias("k"), text.alias("text")))
    return df.select("k", F.explode(G.quantities("text")).alias("p")).select("k", "p.kind", "p.value_num", "p.unit", "p.day_type", "p.qualifier")


#: Citations in sixteen forms, and what they name.
CITED = (
    ("170 IAC {a}-{b}-{c}", ["170 IAC {a}-{b}-{c}"]),
    ("see 327 IAC {a}-6.1-{c}(b)(2)(i), above", ["327 IAC {a}-6.1-{c}"]),
    ("under 170 IAC {a}-{b}", ["170 IAC {a}-{b}"]),
    ("170 IAC {a}-{b}-4 through {a}-{b}-6 and more", ["170 IAC {a}-{b}-4", "170 IAC {a}-{b}-5", "170 IAC {a}-{b}-6"]),
    ("170 IAC {a}-{b}-4 .. {a}-{b}-5", ["170 IAC {a}-{b}-4", "170 IAC {a}-{b}-5"]),
    ("170 IAC {a}-{b}-16.5(a)", ["170 IAC {a}-{b}-16.5"]),
    ("Commission Rule 16 [170 IAC {a}-{b}-16]", ["170 IAC {a}-{b}-16"]),
    ("IC {a}-{b}-2-{c} says", ["IC {a}-{b}-2-{c}"]),
    ("40 CFR {c}", ["40 CFR {c}"]),
    ("29 CFR 1910.{c} and 40 C.F.R. Part {c}", ["29 CFR 1910.{c}", "40 CFR {c}"]),
    ("42 U.S.C. § {c}", ["42 USC {c}"]),
    ("IEEE {c}-2012", ["IEEE {c}-2012"]),
    ("NFPA {c} or ASTM D{c}", ["NFPA {c}", "ASTM D{c}"]),
    ("no citation, only {c} IAC or CFR {c}", []),
    ("18 CFR {c}.1 through {c}.3", ["18 CFR {c}.1", "18 CFR {c}.2", "18 CFR {c}.3"]),
    ("the rule at 170 IAC {a}-{b}-7 through {a}-{b}-7", ["170 IAC {a}-{b}-7"]),
)


def cited_sql() -> str:
    filled = lambda f: "concat(" + ", ".join(f"'{x}'" if i % 2 == 0 else x for i, x in enumerate(re.split(r"\{(\w)\}", f))) + ")"
    return " union all ".join(f"select k, {filled(f)} as citation from (select o_orderkey as k, o_custkey % 9 + 1 as a, o_orderkey % 7 + 1 as b, o_custkey % 80 + 1 as c from orders where o_orderkey % {len(CITED)} = {i}) q" for i, (_, names) in enumerate(CITED) for f in names)


@query("H7_citation_forms", cited_sql())
def citation_forms(t, spark):
    """Citations of sixteen forms: ranges as their sections, subsections under theirs, brackets, decimals."""
    numbers = {"a": F.col("o_custkey") % 9 + 1, "b": F.col("o_orderkey") % 7 + 1, "c": F.col("o_custkey") % 80 + 1}
    text = F.lit(None).cast("string")
    for i, (form, _) in enumerate(CITED):
        parts = [F.lit(x) if j % 2 == 0 else numbers[x].cast("string") for j, x in enumerate(re.split(r"\{(\w)\}", form))]
        text = F.when(F.col("o_orderkey") % len(CITED) == i, F.concat(*parts)).otherwise(text)
    df = spread(t("orders").select(F.col("o_orderkey").alias("k"), text.alias("text")))
    return df.select("k", F.explode(G.citations("text")).alias("c")).select("k", "c.citation")


@query("H11_excluded_numbers", f"select k, cast(d * 1000 as double) as value_num from {O}")
def excluded_numbers(t, spark):
    """Phone numbers, form numbers and versions are no parameters; thousands in words are."""
    df = written(t, "Call 317-555-%04d about Form FM-%d, version 2.%d.1, for %d thousand gallons", F.col("k") % 10000, "a", "b", "d")
    return spread(df.select("k", "text")).select("k", F.explode(G.parameters("text")).alias("p")).select("k", "p.value_num")


@query("H12_number_words", "select p_partkey, cast(p_size as double) as n from part")
def number_words(t, spark):
    ones, tens = (F.array(*[F.lit(w) for w in x]) for x in (G.NUMBERS, ["", "", *G.TENS]))
    n = F.col("p_size").cast("int")
    ten, one = F.floor(n / 10).cast("int"), n % 10
    text = F.when(n < 20, F.get(ones, n)).when(one == 0, F.get(tens, ten)).otherwise(F.concat(F.get(tens, ten), F.lit("-"), F.get(ones, one)))
    return t("part").select("p_partkey", F.get(G.parameters(text), 0)["value_num"].alias("n"))


@query("H5_all_offsets", "select doc_id, cast(sum(length(part)) over (partition by doc_id order by i) + (i - 1) * 3 as bigint) as start from (select doc_id, unnest(string_split(text, 'the')) as part, generate_subscripts(string_split(text, 'the'), 1) as i from documents) qualify i < max(i) over (partition by doc_id)")
def all_offsets(t, spark):
    return t("documents").select("doc_id", F.explode(G.offsets("text", F.lit("the"))).alias("o")).select("doc_id", F.col("o.start").cast("long").alias("start"))


@query("H6_quote_spans", f"select k, case when st <> 'P' then 4 end as start, case when st <> 'P' then 26 + length(cast(k as varchar)) end as stop from {O}")
def quote_spans(t, spark):
    df = written(t, "The “Utility”  shall file %d reports", "k").withColumn("q", by_status(F='"utility" shall file %d', O="“UTILITY” shall  file %d", P="other words here %d"))
    return df.select("k", G.quote_span("text", "q").alias("s")).select("k", F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"))


@query("H9_rule_key", f"select k, format('{{}} IAC {{}}-{{}}', a, b, c) as state, format('{{}} CFR {{}}', f, p) as federal from {O}")
def rule_key(t, spark):
    state, federal = F.format_string("%d IAC %d-%d-%d(a)", "a", "b", "c", "d"), F.format_string("%d CFR %d.%d", "f", "p", "s")
    return orders(t).select("k", T.rule_key(state).alias("state"), T.rule_key(federal).alias("federal"))


#: Citations in nine forms, their rule and the section that they are in.
KEYED = (
    ("170 IAC {a}-{b}-{c}(b)(2)", "170 IAC {a}-{b}", "170 IAC {a}-{b}-{c}"),
    ("327 IAC {a}-6.1-{c}", "327 IAC {a}-6.1", "327 IAC {a}-6.1-{c}"),
    ("170 IAC {a}-{b}", "170 IAC {a}-{b}", "170 IAC {a}-{b}"),
    ("40 CFR {c}.{b}(a)(1)(ii)", "40 CFR {c}", "40 CFR {c}.{b}"),
    ("18 CFR Part {c}", "18 CFR {c}", "18 CFR Part {c}"),
    ("29 CFR 1910.{c} (e)", "29 CFR 1910", "29 CFR 1910.{c}"),
    ("170 IAC {a}-{b}-16.5(a)", "170 IAC {a}-{b}", "170 IAC {a}-{b}-16.5"),
    ("IC {a}-{b}-2", None, "IC {a}-{b}-2"),
    ("no rule {c}", None, "no rule {c}"),
)


def filled_sql(form: str | None) -> str:
    return "cast(null as varchar)" if form is None else "concat(" + ", ".join(f"'{x}'" if i % 2 == 0 else x for i, x in enumerate(re.split(r"\{(\w)\}", form))) + ")"


@query("H9_rules_of_forms", "select k, " + ", ".join("case " + " ".join(f"when k % {len(KEYED)} = {i} then {filled_sql(f[j])}" for i, f in enumerate(KEYED)) + f" end as {name}" for j, name in ((1, "rule"), (2, "section"))) + " from (select o_orderkey as k, o_custkey % 9 + 1 as a, o_orderkey % 7 + 1 as b, o_custkey % 80 + 1 as c from orders) q")
def rules_of_forms(t, spark):
    """The rule of a citation and the section that its subsections are in, in nine forms."""
    numbers = {"a": F.col("o_custkey") % 9 + 1, "b": F.col("o_orderkey") % 7 + 1, "c": F.col("o_custkey") % 80 + 1}
    text = F.lit(None).cast("string")
    for i, (form, *_) in enumerate(KEYED):
        parts = [F.lit(x) if j % 2 == 0 else numbers[x].cast("string") for j, x in enumerate(re.split(r"\{(\w)\}", form))]
        text = F.when(F.col("o_orderkey") % len(KEYED) == i, F.concat(*parts)).otherwise(text)
    return t("orders").select(F.col("o_orderkey").alias("k"), T.rule_key(text).alias("rule"), T.section_level(text).alias("section"))


@query("H12_words_and_back", "with w as (select p_partkey, p_partkey % 999 + 1 as n, ['one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'] as o, ['ten','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'] as t from part), p as (select *, n // 100 as h, n % 100 as r from w) select p_partkey, n, trim(case when h > 0 then o[h] || ' hundred ' else '' end || case when r = 0 then '' when r < 20 then o[r] when r % 10 = 0 then t[r // 10] else t[r // 10] || '-' || o[r % 10] end) as words from p")
def words_and_back(t, spark):
    """Numbers up to 999 in words, and the words as numbers again."""
    n = (F.col("p_partkey") % 999 + 1).cast("long")
    words = spread(t("part").select("p_partkey", n.alias("n"))).withColumn("words", V.in_words("n"))
    return words.select("p_partkey", V.numbers_in("words").alias("n"), "words")


@query("H10_section_level", f"select k, {IAC} as section from {O}")
def section_level(t, spark):
    return written(t, "%d IAC %d-%d-%d(a)(%d)", "a", "b", "c", "d", "d").select("k", T.section_level(F.col("text")).alias("section"))


@query("H14_singular", "select p_partkey, case p_size % 4 when 0 then 'day' when 1 then 'facilitie' when 2 then 'pas' else 'kwh' end as one, case p_size % 4 when 0 then 'day' when 1 then 'facility' when 2 then 'pass' else 'kwh' end as two from part")
def singular(t, spark):
    unit = F.get(F.array(*[F.lit(u) for u in ("Days", "facilities", "pass", "kWh")]), (F.col("p_size") % 4).cast("int"))
    return t("part").select("p_partkey", T.singular_unit(unit).alias("one"), T.singular_word(unit).alias("two"))


@query("H2_strip_metadata", f"select k, format('Keep {{}} as it is.', k) as bare from {O}")
def strip_metadata(t, spark):
    text = by_status(F="Sec. 1. Keep %d as it is. Authority: IC 8-1-1 Affected: IC 8-1-2 (filed Jan 1, 2001: 24 IR 5)", O="Keep %d as it is. [45 FR 123, Jan. 1, 1980]", P="Keep  %d as it is. 20240101-IR-170240001PRA")
    system = F.when(F.col("st") == "F", "iac").when(F.col("st") == "O", "cfr").otherwise("iac")
    return orders(t).select("k", T.strip_metadata(text, system).alias("bare"))


@query("H13_value_replaced", f"select k, format('file within {{}} days, or {{}} days before', s + 5, s + 5) as text from {O}")
def value_replaced(t, spark):
    days = lambda n: F.concat(n.cast("string"), F.lit(" days"))
    return written(t, "file within %d days, or %d days before", "s", "s").select("k", F.replace("text", days(F.col("s")), days(F.col("s") + 5)).alias("text"))


@query("H13_nearest_value", f"""select k, case st when 'F' then format('Within {{}} days, or within {{}} days of notice, {{}}-{{}} stays', s, n, s, s) when 'O' then format('In 1{{}} days or {{}} hours, not {{}}.5 or {{}} days', s, s, s, n) end as text from (select o.k, o.s, st, greatest(cast(round_even(o.s * 1.5, 0) as bigint), o.s + 1) as n from {O}) q""")
def nearest_value(t, spark):
    """Of several places of a number the one nearest to a position gets the new value; numbers that are part of others stay."""
    f = lambda form, n: F.format_string(form, *["s"] * n)
    text = F.when(F.col("st") == "F", f("Within %d days, or within %d days of notice, %d-%d stays", 4)).when(F.col("st") == "O", f("In 1%d days or %d hours, not %d.5 or %d days", 4)).otherwise(f("No such number, only 1%d and %d-1", 2))
    near = F.when(F.col("st") == "F", F.lit(28)).otherwise(F.lit(60))
    hit = V.replaced(text, F.col("s"), V.changed_value(F.col("s")), near)
    return orders(t).select("k", hit.alias("hit")).select("k", "hit.text")


@query("H15_sentence_window", "select doc_id, case when instr(text, ' the ') > 0 then sha256(substring(text, greatest(1, instr(text, ' the ') - 80), least(instr(text, ' the ') + 84, length(text)) - greatest(1, instr(text, ' the ') - 80) + 1)) end as digest from documents")
def sentence_window(t, spark):
    """The text within 80 characters around the first place of a word."""
    at = F.locate(" the ", F.col("text"))
    low, high = F.greatest(F.lit(1), at - 80), F.least(at + 84, F.length("text"))
    return t("documents").select("doc_id", F.when(at > 0, F.sha2(F.substring(F.col("text"), low, high - low + 1), 256)).alias("digest"))


@query("H16_references", f"select k, 'FORM' as kind, format('FM-{{}}', a) as ref from {O} union all select k, 'CLAUSE', format('{{}}.{{}}.{{}}', b, c, d) from {O} union all select k, 'SHEET', cast(p as varchar) from {O}")
def references(t, spark):
    df = written(t, "See Form FM-%d, clause %d.%d.%d and Sheet No. %d.", "a", "b", "c", "d", "p")
    forms = (("FORM", r"Form ([A-Z]+-\d+)"), ("CLAUSE", r"clause (\d+(?:\.\d+)*)"), ("SHEET", r"Sheet No\. (\d+)"))

    def found(kind, form):
        return F.transform(F.regexp_extract_all("text", F.lit(form), F.lit(1)), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))

    return df.select("k", F.explode(F.concat(*[found(*f) for f in forms])).alias("r")).select("k", "r.kind", "r.ref")


@query("H17_roles", f"select k, case st when 'F' then 'obligation' when 'O' then 'permission' else 'boilerplate' end as role, st <> 'P' as assessable from {O}")
def roles(t, spark):
    c = by_status(F="The utility shall file %d.", O="It may rest %d.", P="Table of contents %d")
    role = F.when(c.rlike(r"(?i)^table of contents"), "boilerplate").when(c.rlike(r"\bmeans\b"), "definition").when(c.rlike(r"\b(shall|must)\b"), "obligation").when(c.rlike(r"\bmay\b"), "permission").otherwise("narrative")
    return orders(t).select("k", role.alias("role")).withColumn("assessable", F.col("role") != "boilerplate")


@query("H19_defined_terms", f"select k, format('Term {{}}', k) as term from {O} where st <> 'P'")
def defined_terms(t, spark):
    text = by_status(F='"Term %d" means a day.', O="Term %d: a device that counts", P="nothing here %d")
    term = F.coalesce(F.nullif(F.regexp_extract(text, r'^"([^"]+)"\s+means', 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^([A-Z][\w ]+):\s+an? ", 1), F.lit("")))
    return orders(t).select("k", term.alias("term")).where("term is not null")


@query("H20_cross_refs", f"select k, format('{{}} FR {{}}', f, k) as first, cast(3 as bigint) as n from {O}")
def cross_refs(t, spark):
    df = written(t, "%d FR %d, %d FR %d, %d CFR Part %d and 20240101-IR-170240001PRA", "f", "k", "f", "k", "f", "p")
    return df.select("k", T.cross_refs(F.col("text")).alias("r")).select("k", F.get("r", 0).alias("first"), F.size("r").cast("long").alias("n"))


#: A text with curly quotes, a dash and two spaces, and quotes of it: with plain signs, in capitals, too short, just long enough, another one, with a line break.
QUOTED = "Each utility \u201cshall file\u201d the report \u2013 number %d \u2013 on  time."
QUOTES = ('shall file" the report - number %d', "SHALL FILE", "on time", " on time. ", "may file the report", "the\nreport \u2014 number %d")


@query("H6_located_quotes", f"""with t as (select k, k % {len(QUOTES)} as i, 'Each utility \u201cshall file\u201d the report \u2013 number ' || k || ' \u2013 on  time.' as t from {O})
select k, case i when 0 then strpos(t, 'shall') - 1 when 1 then strpos(t, 'shall') - 1 when 3 then strpos(t, 'on  time') - 1 when 5 then strpos(t, 'the report') - 1 end as start, case i when 0 then strpos(t, 'number') + 6 + length(cast(k as varchar)) when 1 then strpos(t, 'shall') + 9 when 3 then length(t) when 5 then strpos(t, 'number') + 6 + length(cast(k as varchar)) end as stop from t""")
def located_quotes(t, spark):
    """Where a quote stands in a text, whatever its signs, case and spaces; short ones and others nowhere."""
    fill = lambda f: F.format_string(f, "k") if "%d" in f else F.lit(f)
    quote = F.lit(None).cast("string")
    for i, q in enumerate(QUOTES):
        quote = F.when(F.col("k") % len(QUOTES) == i, fill(q)).otherwise(quote)
    df = spread(orders(t).select("k", fill(QUOTED).alias("text"), quote.alias("quote")))
    return df.select("k", G.quote_span("text", "quote").alias("s")).select("k", F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"))


#: What notes refer to, in six forms, and how many different references they hold, by kind.
NOTES = (
    ("{f} FR {k}, {f} FR {k} again", "{f} FR {k}", 1),
    ("see {f} CFR Part {p} and {a} IAC {b}-{c}-{d}", "{f} CFR Part {p}", 2),
    ("{a} IAC {b}-{c}; {a} IAC {b}-{c}.1-{d}", "{a} IAC {b}-{c}", 2),
    ("document 20240101-IR-170240001PRA, {a} IAC {b}-{c}-{d}, {f} FR {k}", "{f} FR {k}", 3),
    ("{f} CFR {p} has no part, and FR {k} no volume", None, 0),
    ("20240101-IR-170240001FRA and 20240101-IR-170240001FRA", "20240101-IR-170240001FRA", 1),
)


@query("H20_references_of_notes", "select k, " + ", ".join("case " + " ".join(f"when k % {len(NOTES)} = {i} then {said}" for i, said in enumerate(col)) + f" end as {name}" for name, col in (("first", [filled_sql(n[1]) for n in NOTES]), ("n", [f"cast({n[2]} as bigint)" for n in NOTES]))) + f" from {O}")
def references_of_notes(t, spark):
    """Register pages, parts, state sections and document numbers, once each."""
    text = F.lit(None).cast("string")
    for i, (form, *_) in enumerate(NOTES):
        parts = [F.lit(x) if j % 2 == 0 else F.col(x).cast("string") for j, x in enumerate(re.split(r"\{(\w)\}", form))]
        text = F.when(F.col("k") % len(NOTES) == i, F.concat(*parts)).otherwise(text)
    return orders(t).select("k", T.cross_refs(text).alias("r")).select("k", F.get("r", 0).alias("first"), F.size("r").cast("long").alias("n"))


@query("H21_entities", "select o_orderkey as k, 'Alpha' || o_custkey || ' Power Co.' as entity, list_extract([" + ", ".join(f"'{c}'" for c in G.STATES.values()) + "], cast(o_orderkey % 50 + 1 as int)) as state from orders")
def entities(t, spark):
    """The company in a title, and the state by name."""
    names = F.array(*[F.lit(n) for n in G.STATES])
    codes = F.create_map(*[F.lit(x) for pair in G.STATES.items() for x in pair])
    text = F.concat(F.lit("Petition of Alpha"), F.col("o_custkey").cast("string"), F.lit(" Power Co. in "), F.get(names, (F.col("o_orderkey") % 50).cast("int")))
    state = F.regexp_extract(text, r"\b(" + "|".join(sorted(G.STATES, key=len, reverse=True)) + r")$", 1)
    return t("orders").select(F.col("o_orderkey").alias("k"), F.regexp_extract(text, r"of ((?:[A-Z]\w+ )+(?:Co|Inc|LLC|Corp)\.?)", 1).alias("entity"), codes[state].alias("state"))


@query("H22_dates", f"select k, case when k % 4 < 3 then day end as day from {O}")
def dates(t, spark):
    """Dates in three forms; what is none of them has no date."""
    forms = ("MMM d, yyyy", "yyyy-MM-dd", "MM/dd/yyyy")
    text = F.when(F.col("k") % 4 == 0, F.date_format("day", forms[0])).when(F.col("k") % 4 == 1, F.date_format("day", forms[1])).when(F.col("k") % 4 == 2, F.date_format("day", forms[2])).otherwise("no date")
    return orders(t).select("k", F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in forms]).alias("day"))


@query("H23_din_date", f"select k, day from {O}")
def din_date(t, spark):
    text = F.concat(F.date_format("day", "yyyyMMdd"), F.lit("-IR-170240001PRA"))
    return orders(t).select("k", F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")).cast("date").alias("day"))


@query("H31_merged_maps", f"select k, 'a' as name, st as v from {O} union all select k, 'b', cast(b as varchar) from {O} union all select k, 'c', cast(c as varchar) from {O}")
def merged_maps(t, spark):
    """Two maps as one; where both have a key the second counts."""
    text = lambda c: F.col(c).cast("string")
    df = orders(t).select("k", F.create_map(F.lit("a"), F.col("st"), F.lit("b"), text("d")).alias("x"), F.create_map(F.lit("b"), text("b"), F.lit("c"), text("c")).alias("y"))
    kept = F.map_filter("x", lambda k, _: ~F.map_contains_key("y", k))
    return df.select("k", F.explode(F.map_concat(kept, F.col("y"))).alias("name", "v"))


@query("H33_citation_fragment", f"select k, s in (a, b, c, d) as is_fragment from {O}")
def citation_fragment(t, spark):
    cites = F.array(F.format_string("%d IAC %d-%d-%d", "a", "b", "c", "d"))
    return orders(t).select("k", F.exists(cites, lambda c: F.array_contains(F.split(c, r"[^\d.]+"), F.col("s").cast("string"))).alias("is_fragment"))


@query("I3_only_signs", f"select k, st = 'F' as only_signs from {O}")
def only_signs(t, spark):
    return orders(t).select("k", G.only_signs_changed(F.format_string("report %d: a quarter.", "k"), by_status(F="report %d; a quarter!", O="report %d: 45 days.", P="report %d: a quarter.")).alias("only_signs"))


@query("I4_change_class", f"select k, case k % 8 when 0 then 'repealed' when 1 then 'cosmetic' when 2 then 'cosmetic' when 3 then 'metadata_only' when 4 then 'punctuation_only' when 5 then 'cross_ref_only' else 'substantive' end as change_class from {O}")
def change_class(t, spark):
    """Each kind of change in turn, with the order's key in the section's text."""
    base = F.format_string(BASE.replace("{}", "%d"), "k")
    lists = lambda x: F.concat(base, F.lit(f" Authority: IC 8-1-1{x} Affected: IC 8-1-2"))
    refs = lambda x: F.concat(base, F.format_string(f" See %d IAC 4-1-{x} of this rule.", "a"))
    swap = lambda a, b: F.replace(base, F.lit(a), F.lit(b))
    cases = [(base, None, "repealed"), (base, base, "approved"), (base, swap(" ", "  "), "approved"), (lists(""), lists("; IC 8-1-3"), "approved"), (base, swap("quarter.", "quarter;"), "approved"), (refs(16), refs(17), "approved"), (base, swap("30 days", "30 business days"), "approved"), (base, swap(" 30 ", " 45 "), "approved")]
    pick = lambda i: F.get(F.array(*[F.lit(c[i]) if c[i] is None or isinstance(c[i], str) else c[i] for c in cases]), (F.col("k") % 8).cast("int"))
    df = orders(t).select("k", F.lit("kb").alias("origin"), F.lit("iac").alias("source_system"), F.lit("1 IAC 2-3-4").alias("citation"), F.lit(10).alias("s1_section_id"), pick(0).alias("s1_text"), pick(1).alias("s2_text"), F.lit("approved").alias("s1_status"), pick(2).alias("s2_status"))
    return engine.classify(df).select("k", "change_class")


@query("I5_renumbered", f"select format('new {{}}', k) as new_citation, format('old {{}}', k) as old_citation from {O} where st = 'P'")
def renumbered(t, spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("w"), (F.col("k") * 31 + i * i).cast("string")))
    df = orders(t).where("st = 'P'").select("k", F.concat(F.lit("b"), (F.col("k") % 10).cast("string")).alias("block"), F.array_join(words, " ").alias("text"))
    name = lambda p, text: df.select("block", F.concat(F.lit(p), F.col("k").cast("string")).alias("citation"), text.alias("text"))
    return engine.renumbered(name("new ", F.concat("text", F.lit(" end"))), name("old ", F.col("text"))).select("new_citation", "old_citation")


@query("C39_greedy_matches", """with e as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' as want, case when l_returnflag = 'R' then l_suppkey % 3 else l_partkey % 3 end as clause from lineitem), r as (select *, row_number() over (partition by l_orderkey, want, clause order by l_linenumber, l_partkey, l_suppkey) as n from e)
select a.l_orderkey, a.l_linenumber as expected, b.l_linenumber as found, a.l_partkey from r a join r b on a.l_orderkey = b.l_orderkey and a.clause = b.clause and a.n = b.n where a.want and not b.want""")
def greedy_matches(t, spark):
    """One to one and in order: the n-th expected finding of a clause takes the n-th that was found."""
    want = F.col("l_returnflag") == "R"
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", want.alias("want"), F.when(want, F.col("l_suppkey") % 3).otherwise(F.col("l_partkey") % 3).alias("clause"))
    return joins.match_in_order(rows.where("want"), rows.where("not want"), ["l_orderkey", "clause"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", F.col("a.l_linenumber").alias("expected"), F.col("b.l_linenumber").alias("found"), "a.l_partkey")


def findings(t):
    """Returned lineitems as expected findings and the others as found ones: the order is the document, the supplier the section, part and line the clause."""
    l = t("lineitem").withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    clause = F.concat_ws(".", (F.col("l_partkey") % 4).cast("string"), (F.col("l_linenumber") % 3).cast("string"))
    citation = F.format_string("170 IAC 4-1-%d", F.col("l_suppkey") % 3)
    of = l.select(F.col("l_orderkey").alias("doc_id"), "id", F.col("l_linenumber").alias("ordinal"), citation.alias("citation"), clause.alias("clause"), "l_returnflag", "l_partkey", "l_tax")
    expected = of.where("l_returnflag = 'R'").select("doc_id", F.col("id").alias("finding_id"), "ordinal", F.concat("citation", F.lit("(a)")).alias("citation"), F.array("clause", F.concat((F.col("l_partkey") % 4).cast("string"), F.lit(".9"))).alias("acceptable_clause_ids"), (F.col("l_tax") > 0.03).alias("parent_tolerance"))
    parent = F.when(F.col("l_partkey") % 5 == 0, F.substring_index("clause", ".", 1)).otherwise(F.col("clause"))
    system = of.where("l_returnflag <> 'R'").select("doc_id", F.col("id").alias("system_id"), "ordinal", "citation", parent.alias("clause_id"))
    return expected, system


@query("C39_scored_findings")
def scored_findings(t, spark):
    """Expected findings with the found ones that they take, in order, parents of a clause tolerated where that is said."""
    return scoring.matches(*findings(t))


@query("E16_preceding_tokens", f"select k, case st when 'F' then 'calendar' when 'O' then 'business' end as qualifier from {O}")
def preceding_tokens(t, spark):
    """The last qualifier among the six words before a quantity."""
    df = orders(t).withColumn("text", by_status(F="no business day within the next calendar period of %d days", O="aa bb cc dd business x period of %d days", P="calendar aa bb cc dd ee ff %d days"))
    at = F.get(G.parameters("text"), 0)["start"]
    before = F.slice(F.split(F.trim(F.substring(F.col("text"), F.lit(1), at)), " "), -6, 6)
    return df.select("k", F.get(F.reverse(F.filter(before, lambda w: w.isin("business", "calendar", "working"))), 0).alias("qualifier"))


#: A qualifier by the order's number, fillers between it and the quantity, and for every third order an earlier one.
PHRASES = ("not less than", "Not more than", "no later  than", "at least", "prior to", "within", "AFTER", "exactly", "thereabout")
MEANS = ("at_least", "not_more_than", "not_more_than", "at_least", "prior_to", "within", "after", "exactly", None)
PICKED = "array(" + ", ".join(f"'{p}'" for p in PHRASES) + ")"
SAID = "case when {a} + array_length(string_split(trim(regexp_replace({p}, ' +', ' ', 'g')), ' ')) <= 6 then {m} end"


@query("E16_qualifiers", f"""with o as (select o_orderkey as k, cast(o_orderkey % 9 as int) as i, cast(o_custkey % 6 as int) as a from orders), l as (select *, list_value({", ".join(f"'{p}'" for p in PHRASES)})[i + 1] as p, list_value({", ".join(f"'{m}'" if m else "null" for m in MEANS)})[i + 1] as m from o)
select k, coalesce({SAID.format(a="a", p="p", m="m")}, case when k % 3 = 0 and a + len(string_split(regexp_replace(p, ' +', ' ', 'g'), ' ')) + 2 <= 6 then 'at_least' end) as qualifier from l""")
def qualifiers(t, spark):
    """The last of eight qualifiers among the six words before a quantity."""
    phrase = F.get(F.expr(PICKED), (F.col("k") % 9).cast("int"))
    df = t("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 6).cast("int").alias("a"))
    head = F.concat(F.when(F.col("k") % 3 == 0, "It takes at least ").otherwise("It takes "), phrase, F.lit(" "), F.repeat(F.lit("some "), F.col("a")))
    return df.withColumn("head", head).select("k", T.qualifier(F.concat("head", F.lit("30 days, within reason")), F.length("head")).alias("qualifier"))


@query("E17_greedy_spans", f"""with s as (select k, a, b, st from {O}) select k, case st when 'F' then '0-9,9-12' when 'O' then '0-4,4-8' else '2-20' end as spans from s""")
def greedy_spans(t, spark):
    """Spans of several patterns by start, the longer one first, without overlaps."""
    of = lambda *pairs: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in pairs])
    spans = F.when(F.col("st") == "F", of((9, 12), (0, 4), (0, 9), (8, 30), (3, 7))).when(F.col("st") == "O", of((4, 8), (0, 4), (1, 4), (7, 9))).otherwise(of((3, 4), (2, 20), (2, 3), (19, 25)))
    kept = T.greedy_spans(spans)
    return orders(t).select("k", F.array_join(F.transform(kept, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("spans"))


@query("H22_last_dates", f"select k, case k % 5 when 4 then null else day end as day from {O}")
def last_dates(t, spark):
    """The last of several dates of a note, whatever their forms; a date that is none counts as none."""
    form = lambda f: F.date_format("day", f)
    text = F.expr("''")
    notes = {0: ("filed Jan 5, 1980: 3 IR 4; repealed ", form("MMM d, yyyy")), 1: ("(Repealed 1/2/1990, effective ", form("M/d/yyyy")), 2: ("approved 1999-01-01; Sept. 3, 2000; ", form("yyyy-MM-dd")), 3: ("filed 2/3/1971 and ", form("MMMM d, yyyy"))}
    for i, (note, day) in notes.items():
        text = F.when(F.col("k") % 5 == i, F.concat(F.lit(note), day, F.lit(", 10:00 a.m.)"))).otherwise(text)
    return orders(t).select("k", T.last_date(F.when(F.col("k") % 5 == 4, F.lit("filed Smarch 13, 2001")).otherwise(text)).alias("day"))


@F.pandas_udf(BooleanType())
def allowed(statement: pd.Series) -> pd.Series:
    return pd.Series([profiling.refuse(s) is None for s in statement])


@query("L2_refused_sql", f"select k, st = 'F' as allowed from {O}")
def refused_sql(t, spark):
    return orders(t).select("k", allowed(by_status(F="with a as (select %d as x) select * from a", O="drop table t%d", P="select 1; select %d")).alias("allowed"))


@query("M2_verbatim", f"select k, st <> 'P' as verified from {O}")
def verbatim(t, spark):
    """Only items whose quote stands in the text word for word are kept as verified."""
    df = written(t, "Each utility shall file report number %d on time", "k").withColumn("q", by_status(F="SHALL file report number %d", O="utility shall file  report number %d", P="may file report number %d"))
    return df.select("k", T.quoted(F.col("text"), F.col("q")).alias("verified"))
