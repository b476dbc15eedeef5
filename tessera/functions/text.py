"""Text functions as column expressions; what Spark has no expression for is an Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

SEGMENTS = ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())]))
TOKEN = r"(?U)\w+|[^\w\s]"
#: Forms of citations.
CFR = r"(\d+)\s+CFR\s+(?:[Pp]art\s+)?(\d+)(?:\.(\d+))?"
IAC = r"(\d+)\s+IAC\s+(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)(?:-(\d+(?:\.\d+)?))?"
FR = r"\d+\s+FR\s+\d+"
DIN = r"\d{8}-IR-\d{9}[A-Z]{3}"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_for_diff(text: Column, system: Column) -> Column:
    """A section's text without what an amendment's form changes: section labels and filing notes (iac), register footers (cfr), white space."""
    state = F.regexp_replace(text, r"^\s*Sec\. \d+(?:\.\d+)?\.\s*", "")
    # filing histories, with one level of brackets within; a note of repeal stays
    state = F.regexp_replace(state, r"\((?!Repealed)(?:[^()]|\([^()]*\))*(?:;|filed|readopted)(?:[^()]|\([^()]*\))*\)", "")
    state = F.regexp_replace(state, r"(\w)\s+-\s*(\w)", "$1-$2")
    federal = F.regexp_replace(text, r"\[\d+ FR \d+[^\]]*\]", "")
    federal = F.regexp_replace(federal, r"(?i)link to an amendment published at[^.]*\.", "")
    return squeeze(F.when(system == "iac", state).when(system == "cfr", federal).otherwise(text))


def strip_metadata(text: Column, system: Column) -> Column:
    """normalize_for_diff() without lists of authority and affected laws, document numbers and notices."""
    out = F.regexp_replace(normalize_for_diff(text, system), r"Authority:\s*(?:IC [\d.\-]+[;,]?\s*)+", "")
    out = F.regexp_replace(out, r"Affected:\s*(?:IC [\d.\-]+[;,]?\s*)+", "")
    return squeeze(F.regexp_replace(F.regexp_replace(out, DIN, ""), FR, ""))


def words_only(c: Column) -> Column:
    """Tokens that are no punctuation, joined."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(?U)(\w+)"), F.lit(1)), " ")


def without_citations(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(c, CFR, "<ref>"), IAC, "<ref>"))


def rule_key(citation: Column) -> Column:
    """The rule of a section's citation: title and part (federal) or title, article and rule (state)."""
    federal = F.concat_ws(" ", F.regexp_extract(citation, CFR, 1), F.lit("CFR"), F.regexp_extract(citation, CFR, 2))
    state = F.concat(F.regexp_extract(citation, IAC, 1), F.lit(" IAC "), F.regexp_extract(citation, IAC, 2), F.lit("-"), F.regexp_extract(citation, IAC, 3))
    return F.when(citation.rlike(CFR), federal).when(citation.rlike(IAC), state)


def section_level(citation: Column) -> Column:
    """A citation without its trailing subsections: "1 IAC 2-3-4(a)(2)" is in "1 IAC 2-3-4"."""
    return F.trim(F.regexp_replace(citation, r"(\s*\([0-9A-Za-z]+\))+\s*$", ""))


def cross_refs(text: Column) -> Column:
    """Register pages, parts, state sections and document numbers that a text names, once each."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (FR, r"\d+ CFR Part \d+", r"\d+ IAC \d+(?:\.\d+)?-\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?", DIN)]
    return F.array_distinct(F.concat(*found))


def singular_unit(unit: Column) -> Column:
    """Lower case without a plural s (the candidates' rule)."""
    return F.regexp_replace(F.lower(unit), r"s$", "")


def singular_word(unit: Column) -> Column:
    """The rules' rule: -ies is -y, a double s stays."""
    u = F.lower(unit)
    return F.when(u.endswith("ies"), F.regexp_replace(u, "ies$", "y")).when(u.endswith("ss"), u).otherwise(F.regexp_replace(u, "s$", ""))


def aligned(published: Column, effective: Column, before: int = 7, after: int = 365) -> Column:
    """Whether two dates can belong together: within -before to +after days; one unknown passes, two don't."""
    gap = F.datediff(effective, published)
    return F.when(published.isNull() & effective.isNull(), False).when(published.isNull() | effective.isNull(), True).otherwise(gap.between(-before, after))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day), F.lit("-Q"), F.quarter(day))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def shingles(words: Column, n: int = 5, hashed: bool = False) -> Column:
    """The distinct runs of n words (or their hashes); a shorter text is one. The words are bound once, not computed anew for every run."""
    put = (lambda w: F.xxhash64(F.array_join(w, " "))) if hashed else (lambda w: F.array_join(w, " "))
    runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: put(F.slice(w, i, n)))).otherwise(F.array(put(w)))
    return F.array_distinct(F.transform(F.array(words), runs)[0])


def chunks(words: Column, size: int = 500, overlap: int = 50) -> Column:
    """Overlapping windows of words as (position, words); the last is the first one that reaches the end."""
    step = size - overlap
    n = F.size(words)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    at = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk"), F.slice(words, i * step + 1, size).alias("words")))
    return F.when(n > 0, at).otherwise(F.array().cast("array<struct<chunk:int,words:array<string>>>"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def natural_key(c: Column, width: int = 12) -> Column:
    """Sorts "9-2" before "10-1": digits are filled up."""
    parts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


# What words before a quantity say of it.
QUALIFIERS = (("not\\s+less\\s+than", "at_least"), ("not\\s+more\\s+than", "not_more_than"), ("no\\s+later\\s+than", "not_more_than"), ("at\\s+least", "at_least"), ("prior\\s+to", "prior_to"), ("within\\b", "within"), ("after\\b", "after"), ("exactly\\b", "exactly"))
DATES = r"[A-Z][a-z]{2,8}\.? \d{1,2}, \d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}"


def qualifier(text: Column, start: Column, tokens: int = 6) -> Column:
    """What the last qualifier among the six tokens before a place (in characters, from 0) says; a phrase that begins before them isn't one."""
    before = F.split(F.trim(F.substring(text, F.lit(1), start)), r"\s+")
    window = F.array_join(F.slice(before, F.greatest(F.size(before) - tokens + 1, F.lit(1)), F.lit(tokens)), " ")
    last = F.regexp_extract(window, "(?is)^.*(" + "|".join(p for p, _ in QUALIFIERS) + ")", 1)
    return F.when(last != "", F.coalesce(*[F.when(last.rlike("(?i)^" + p + ("$" if not p.endswith("b") else "")), name) for p, name in QUALIFIERS]))


def last_date(text: Column) -> Column:
    """The last date that stands in a text, in any of three forms; months by name or abbreviated."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(DATES), F.lit(0)), F.lit(-1))
    named = F.regexp_replace(last, r"^([A-Z][a-z]{2})[a-z]*\.? ", "$1 ")
    return F.coalesce(F.try_to_timestamp(named, F.lit("MMM d, yyyy")), F.try_to_timestamp(last, F.lit("M/d/yyyy")), F.try_to_timestamp(last, F.lit("yyyy-MM-dd"))).cast("date")


def greedy_spans(spans: Column) -> Column:
    """Of spans (structs with start and stop) those that don't overlap, taken by start, then the longer one first."""
    rank = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["stop"]).alias("shorter"), s.alias("span")))
    none = F.slice(spans, 1, 0)
    step = lambda a, r: F.when((F.size(a) == 0) | (F.try_element_at(a, F.lit(-1))["stop"] <= r["start"]), F.concat(a, F.array(r["span"]))).otherwise(a)
    return F.aggregate(F.array_sort(rank), none, step)


def rendered_diff(segments: Column, edge: int = 300) -> Column:
    """A word diff as text: [-deleted-] {+inserted+}; of long equal runs only both ends stay."""
    text = lambda s: F.when(s["op"] == "delete", F.concat(F.lit("[-"), s["text"], F.lit("-]"))).when(s["op"] == "insert", F.concat(F.lit("{+"), s["text"], F.lit("+}"))).when(F.length(s["text"]) > 2 * edge, F.concat(F.left(s["text"], F.lit(edge)), F.lit(" ... "), F.right(s["text"], F.lit(edge)))).otherwise(s["text"])
    return F.when(F.size(segments) > 0, F.array_join(F.transform(segments, text), " ")).otherwise("(no word diff)")


WINDOWS = StructType([StructField("old", StringType()), StructField("new", StringType())])


def around_hunks(old: str, new: str, most: int, window: int) -> tuple[str, str]:
    """Both texts; what is longer than ``most`` only within ``window`` characters of what differs (its start, if nothing of it does), "..." between."""
    import difflib
    import re

    if len(old) <= most and len(new) <= most:
        return old, new
    x, y = ([m for m in re.finditer(r"\w+|[^\w\s]", t)] for t in (old, new))
    ops = [o for o in difflib.SequenceMatcher(None, [m[0] for m in x], [m[0] for m in y], autojunk=False).get_opcodes() if o[0] != "equal"]

    def cut(text: str, tokens: list, runs: list[tuple[int, int]]) -> str:
        if len(text) <= most:
            return text
        merged: list[list[int]] = []
        for a, b in ((max(0, tokens[i].start() - window), min(len(text), tokens[j - 1].end() + window)) for i, j in runs if j > i):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return ("..." if merged and merged[0][0] else "") + "\n...\n".join(text[a:b] for a, b in merged) if merged else text[:most]

    return cut(old, x, [o[1:3] for o in ops]), cut(new, y, [o[3:5] for o in ops])


@F.pandas_udf(WINDOWS)
def hunk_windows(old: pd.Series, new: pd.Series, most: pd.Series, window: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([around_hunks(a or "", b or "", int(m), int(w)) for a, b, m, w in zip(old, new, most, window, strict=True)], columns=["old", "new"])


@F.pandas_udf(SEGMENTS)
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Segments that are equal, deleted or inserted, by difflib over words and signs; neighbours of one kind are one."""
    import difflib
    import re

    def one(a: str | None, b: str | None) -> list[dict]:
        x, y = (re.findall(r"\w+|[^\w\s]", t or "") for t in (a, b))
        out: list[dict] = []
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            for kind, part in (("equal", x[i1:i2]),) if op == "equal" else (("delete", x[i1:i2]), ("insert", y[j1:j2])):
                if part and out and out[-1]["op"] == kind:
                    out[-1]["text"] += " " + " ".join(part)
                elif part:
                    out.append({"op": kind, "text": " ".join(part)})
        return out

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


@F.pandas_udf(StringType())
def clause_normal(text: pd.Series) -> pd.Series:
    """NFKC, lower case, plain quotes and dashes, no emphasis marks or link targets, single spaces."""
    import re
    import unicodedata

    plain = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "})

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", unicodedata.normalize("NFKC", t).translate(plain))
        return re.sub(r"\s+", " ", re.sub(r"[*_`]+", "", t)).strip().lower()

    return pd.Series([one(t) for t in text])


def quoted(text: Column, quote: Column, least: int = 8) -> Column:
    """Whether a quote stands in a text, both normalised."""
    q = clause_normal(quote)
    return (F.length(q) >= least) & F.contains(clause_normal(text), q)


SIGNED = 64


@F.arrow_udf(ArrayType(DoubleType()))
def signed_sums(hashes: pa.Array) -> pa.Array:
    """Of each row's hashes sums of their signs in 64 dimensions, in one pass; of null, nulls."""
    rows = len(hashes)
    flat = hashes.flatten().to_numpy(zero_copy_only=False)
    whose = np.repeat(np.arange(rows), hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8"))
    sums = np.bincount(whose * SIGNED + (flat & (SIGNED - 1)), np.where(flat > 0, 1.0, -1.0), rows * SIGNED)
    none = np.repeat(hashes.is_null().to_numpy(zero_copy_only=False), SIGNED)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype="i4") * SIGNED), pa.array(sums, mask=none))
