"""Citations, parameters and quotes in running text, by Arrow UDFs (they need offsets in characters)."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from tessera.functions.text import QUALIFIERS
from tessera.functions.values import ONES
from tessera.functions.values import TENS as TEN_WORDS

CITATION = StructType([StructField(n, k) for n, k in (("kind", StringType()), ("rule_key", StringType()), ("citation", StringType()), ("subsection", StringType()), ("start", IntegerType()), ("stop", IntegerType()))])
PARAMETER = StructType([StructField(n, k) for n, k in (("kind", StringType()), ("value_text", StringType()), ("value_num", DoubleType()), ("unit", StringType()), ("day_type", StringType()), ("start", IntegerType()), ("stop", IntegerType()))])
SPAN = StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])
SPANS = ArrayType(SPAN)

# How citations and quantities are written.
NUMBERS = {w: i for i, w in enumerate(ONES)}
TENS = {w: 10 * (i + 2) for i, w in enumerate(TEN_WORDS)}
UNITS = ["second", "minute", "hour", "day", "week", "month", "quarter", "year", "percent", "foot", "feet", "inch", "mile", "meter", "pound", "gallon", "volt", "kilovolt", "kv", "kw", "kwh", "mw", "mwh", "kva", "customer"]
NUMBER = r"(?:\d[\d,]*(?:\.\d+)?|" + "|".join([*TENS, *NUMBERS]) + r")(?:-(?:" + "|".join(list(NUMBERS)[1:10]) + r"))?"
FORMS = (
    ("cfr", re.compile(r"(\d+)\s+C\.?F\.?R\.?\s+(?:[Pp]arts?\s+|§+\s*)?(\d+)(?:\.(\d+)(?:\s*(?:through|to|-)\s*(?:\d+\.)?(\d+))?)?")),
    ("iac", re.compile(r"(\d+)\s+IAC\s+(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)(?:-(\d+(?:\.\d+)?)((?:\([0-9A-Za-z]+\))*)(?:\s*(?:through|to|\.\.)\s*(?:\d+\s+IAC\s+)?(?:\2-\3-)?(\d+)(?![\d.]*-))?)?")),
    ("ic", re.compile(r"\bIC\s+(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)(?:-(\d+(?:\.\d+)?))?(?:-(\d+(?:\.\d+)?))?")),
    ("usc", re.compile(r"(\d+)\s+U\.?S\.?C\.?\s+(?:§+\s*)?(\d+[a-z]?)")),
    ("standard", re.compile(r"\b(NERC|IEEE|ANSI|NESC|ASTM|NFPA|IEC|ISO)\s+([A-Z]{0,4}-?\d[\w.\-]*)")),
)
#: Letters without which a form isn't in a text: all of one of these.
MARKS = {"cfr": ("CFR",), "iac": (("IAC",),), "ic": (("IC",),), "usc": ("USC",), "standard": tuple((x,) for x in ("NERC", "IEEE", "ANSI", "NESC", "ASTM", "NFPA", "IEC", "ISO"))}
#: The states by name.
STATES = {
    "Alabama": "AL",
    "Alaska": "AK",
    "Arizona": "AZ",
    "Arkansas": "AR",
    "California": "CA",
    "Colorado": "CO",
    "Connecticut": "CT",
    "Delaware": "DE",
    "Florida": "FL",
    "Georgia": "GA",
    "Hawaii": "HI",
    "Idaho": "ID",
    "Illinois": "IL",
    "Indiana": "IN",
    "Iowa": "IA",
    "Kansas": "KS",
    "Kentucky": "KY",
    "Louisiana": "LA",
    "Maine": "ME",
    "Maryland": "MD",
    "Massachusetts": "MA",
    "Michigan": "MI",
    "Minnesota": "MN",
    "Mississippi": "MS",
    "Missouri": "MO",
    "Montana": "MT",
    "Nebraska": "NE",
    "Nevada": "NV",
    "New Hampshire": "NH",
    "New Jersey": "NJ",
    "New Mexico": "NM",
    "New York": "NY",
    "North Carolina": "NC",
    "North Dakota": "ND",
    "Ohio": "OH",
    "Oklahoma": "OK",
    "Oregon": "OR",
    "Pennsylvania": "PA",
    "Rhode Island": "RI",
    "South Carolina": "SC",
    "South Dakota": "SD",
    "Tennessee": "TN",
    "Texas": "TX",
    "Utah": "UT",
    "Vermont": "VT",
    "Virginia": "VA",
    "Washington": "WA",
    "West Virginia": "WV",
    "Wisconsin": "WI",
    "Wyoming": "WY",
}
#: A range of more sections than this is taken for two citations, its ends.
RANGE = 1000


def number_of(text: str) -> float | None:
    """A number in digits or words up to ninety-nine."""
    t = text.lower().replace(",", "")
    if re.fullmatch(r"\d+(?:\.\d+)?", t):
        return float(t)
    ten, _, one = t.partition("-")
    if ten in TENS:
        return float(TENS[ten] + NUMBERS.get(one, 0))
    return float(NUMBERS[ten]) if ten in NUMBERS and not one else None


def numbers_of(low: str, high: str | None) -> list[str]:
    """The sections of a range; both ends may be one."""
    if not high or "." in low or int(high) <= int(low):
        return [low]
    return [str(n) for n in range(int(low), int(high) + 1)] if int(high) - int(low) < RANGE else [low, high]


def find_citations(text: str) -> list[dict]:
    """All citations in order of place; a range of sections is one for each; what lies in another is left out."""
    hits = [(m.start(), -m.end(), kind, m) for kind, form in FORMS if any(all(x in text for x in marks) for marks in MARKS[kind]) for m in form.finditer(text)]
    out, reached = [], 0
    for start, stop, kind, m in sorted(hits, key=lambda h: h[:2]):
        if start < reached:
            continue
        reached, g, within = -stop, m.groups(), ""
        if kind == "cfr":
            rule = f"{g[0]} CFR {g[1]}"
            names = [f"{rule}.{n}" for n in numbers_of(g[2], g[3])] if g[2] else [rule]
        elif kind == "iac":
            rule, within = f"{g[0]} IAC {g[1]}-{g[2]}", g[4] or ""
            names = [f"{rule}-{n}" for n in numbers_of(g[3], g[5])] if g[3] else [rule]
        elif kind == "ic":
            rule = "IC " + "-".join(x for x in g[:2] if x)
            names = ["IC " + "-".join(x for x in g if x)]
        else:
            rule = f"{g[0]} USC {g[1]}" if kind == "usc" else f"{g[0]} {g[1]}"
            names = [rule]
        out += [{"kind": kind, "rule_key": rule, "citation": n, "subsection": within, "start": start, "stop": -stop} for n in names]
    return out


#: What looks like a quantity but names something: telephone numbers, ids with letters, numbered forms and sheets, versions.
NAMED = re.compile(r"(?i)\(?\b\d{3}\)?[-. ]\d{3}-\d{4}\b|\b\d{3}-\d{4}\b|\b1-\d{3}-\d{3}-\d{4}\b|\b[A-Z]{2,}[A-Z\d]*(?:[-_]\d+)+\b|\b(?:form|sheet|docket|cause|order|exhibit|page|figure|table|appendix)\s+(?:no\.?\s*)?[A-Z]*-?\d[\w.\-]*|\b(?:version|rev(?:ision)?\.?|v)\s*\d+(?:\.\d+)*|\b\d+(?:\.\d+){2,}\b")
TIMES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000}
QUANTITY = re.compile(rf"(?i)(?P<dollar>\$\s?)?\b(?P<n>{NUMBER})\b(?:\s*\((?:\d+)\))?(?:[\s-]+(?P<times>{'|'.join(TIMES)})\b)?(?P<pct>\s?%)?(?:[\s-]+(?P<day>business|calendar|working)\b)?(?:[\s-]+(?P<unit>{'|'.join(UNITS)})s?\b)?")
OFTEN = re.compile(r"(?i)\b(annually|annual|monthly|quarterly|weekly|daily|semiannually|biennially)\b")


#: Without any of these a text has no parameter.
MAYBE = re.compile(rf"(?i)\d|\b(?:{'|'.join([*TENS, *NUMBERS])})|\b(?:annual|month|quarter|week|daily|semiannual|biennial)")


class Spans:
    """Stretches of a text that are taken; overlapping ones are one, so that a place is looked up and not searched for."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for a, z in sorted(spans):
            if self.stops and a < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], z)
            else:
                self.starts.append(a)
                self.stops.append(z)

    def free(self, a: int, z: int) -> bool:
        i = bisect_left(self.starts, z)
        return i == 0 or self.stops[i - 1] <= a

    def add(self, a: int, z: int) -> None:
        """One that is free."""
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.stops.insert(i, z)


def find_parameters(text: str) -> list[dict]:
    """Quantities that aren't part of a citation: amounts, percentages, periods, frequencies, thresholds and bare numbers."""
    if not text or not MAYBE.search(text):
        return []
    taken = Spans([(c["start"], c["stop"]) for c in find_citations(text)] + [m.span() for m in NAMED.finditer(text)])
    free, out = taken.free, []
    for m in QUANTITY.finditer(text):
        value = number_of(m["n"])
        if value is None or not free(m.start(), m.end()):
            continue
        value *= TIMES.get((m["times"] or "").lower(), 1)
        unit, day = (m["unit"] or "").lower() or None, (m["day"] or "").lower() or None
        kind = "amount" if m["dollar"] else "percentage" if m["pct"] or unit == "percent" else "period" if unit in UNITS[:8] else "threshold" if unit else "number"
        unit = "dollar" if m["dollar"] else "percent" if m["pct"] else unit
        out.append({"kind": kind, "value_text": m.group(0).strip(), "value_num": value, "unit": unit, "day_type": day, "start": m.start(), "stop": m.end()})
        taken.add(m.start(), m.end())
    for m in OFTEN.finditer(text):
        if free(m.start(), m.end()):
            out.append({"kind": "frequency", "value_text": m.group(0), "value_num": None, "unit": m.group(0).lower(), "day_type": None, "start": m.start(), "stop": m.end()})
    return sorted(out, key=lambda p: p["start"])


QUANTITY_KIND = StructType([*PARAMETER.fields, StructField("qualifier", StringType())])
#: What the sentence round a quantity makes of it, the first that fits.
CONTEXTS = (("record_retention", re.compile(r"\b(?:retain|keep)\b")), ("deadline", re.compile(r"\bby\b|\bno\s+later\s+than\b|\bdue\b")), ("threshold", re.compile(r"\bor\s+more\b|\bexceeds?\b|\bgreater\s+than\b")), ("frequency", re.compile(r"\b(?:every|per|annually|each\s+year)\b")))
QUALIFYING = tuple((re.compile(p, re.IGNORECASE), name) for p, name in QUALIFIERS)
SENTENCE_END = re.compile(r"[.;!?]\s|\n")


def qualifier_of(text: str, start: int, tokens: int = 6) -> str | None:
    """What the last qualifier among the words before a place says."""
    window = " ".join(text[max(0, start - 200) : start].split()[-tokens:])
    found = [(m.end(), -i, name) for i, (form, name) in enumerate(QUALIFYING) for m in form.finditer(window)]
    return max(found)[2] if found else None


def find_quantities(text: str) -> list[dict]:
    """find_parameters() with qualifiers, and kinds by the sentence: amounts, retention, deadlines, thresholds, frequencies, periods, numbers. Bare numbers and words of frequency aren't quantities here."""
    out, ends = [], [m.start() for m in SENTENCE_END.finditer(text)] if text else []
    for p in find_parameters(text):
        if p["unit"] is None or p["value_num"] is None:
            continue
        i = bisect_left(ends, p["start"])
        around = text[ends[i - 1] if i else 0 : ends[i] if i < len(ends) else len(text)].lower()
        what = qualifier_of(text, p["start"])
        timed = p["unit"] in UNITS[:8]
        kind = "amount" if p["unit"] == "dollar" else next((k for k, form in CONTEXTS if form.search(around)), None)
        if kind is None:
            kind = "threshold" if what in ("at_least", "not_more_than") and not timed else "period" if timed else "number"
        out.append({**p, "kind": kind, "qualifier": what})
    return out


def folded(text: str) -> tuple[str, list[int]]:
    """A text in the form in which quotes are compared, and each of its characters' place in the original."""
    import unicodedata

    chars, at, space = [], [], True
    plain = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", plain.get(c, c)).lower():
            if x.isspace():
                if space:
                    continue
                x = " "
            space = x == " "
            chars.append(x)
            at.append(i)
    return "".join(chars), at


def locate(text: str, quote: str, least: int = 8) -> tuple[int, int] | None:
    t, at = folded(text)
    q = folded(quote)[0].strip()
    i = t.find(q) if len(q) >= least else -1
    return None if i < 0 else (at[i], at[i + len(q) - 1] + 1)


def arrow_type(struct: StructType) -> pa.DataType:
    kinds = {StringType(): pa.string(), IntegerType(): pa.int32(), DoubleType(): pa.float64()}
    return pa.list_(pa.struct([(f.name, kinds[f.dataType]) for f in struct.fields]))


@F.arrow_udf(ArrayType(CITATION))
def citations(text: pa.Array) -> pa.Array:
    return pa.array([find_citations(t) if t else [] for t in text.to_pylist()], arrow_type(CITATION))


@F.arrow_udf(ArrayType(PARAMETER))
def parameters(text: pa.Array) -> pa.Array:
    return pa.array([find_parameters(t) if t else [] for t in text.to_pylist()], arrow_type(PARAMETER))


@F.arrow_udf(ArrayType(QUANTITY_KIND))
def quantities(text: pa.Array) -> pa.Array:
    return pa.array([find_quantities(t) if t else [] for t in text.to_pylist()], arrow_type(QUANTITY_KIND))


@F.pandas_udf(SPAN)
def quote_span(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    found = [locate(t or "", q or "") or (None, None) for t, q in zip(text, quote, strict=True)]
    return pd.DataFrame({"start": pd.array([a for a, _ in found], "Int32"), "stop": pd.array([b for _, b in found], "Int32")})


@F.arrow_udf(SPANS)
def offsets(text: pa.Array, needle: pa.Array) -> pa.Array:
    """All verbatim places of a needle: numbers side by side, and never many texts as Python's at once."""
    starts, stops, ends = array("i"), array("i"), array("i", [0])
    for i in range(0, len(text), 64):
        for t, n in zip(text.slice(i, 64).to_pylist(), needle.slice(i, 64).to_pylist(), strict=True):
            at = t.find(n) if t and n else -1
            while at >= 0:
                starts.append(at)
                stops.append(at + len(n))
                at = t.find(n, at + len(n))
            ends.append(len(starts))
    spans = pa.StructArray.from_arrays([pa.array(np.frombuffer(x, "i4") if x else np.zeros(0, "i4")) for x in (starts, stops)], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, "i4")), spans)


@F.pandas_udf(StringType())
def line_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff of lines."""
    import difflib

    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="", n=1)) for a, b in zip(old, new, strict=True)])


@F.pandas_udf(BooleanType())
def only_signs_changed(old: pd.Series, new: pd.Series) -> pd.Series:
    """Whether two texts differ in signs alone, by the tokens that difflib finds changed."""
    import difflib

    def one(a: str, b: str) -> bool:
        x, y = (re.findall(r"\w+|[^\w\s]", t or "") for t in (a, b))
        parts = [t for op, i, j, k, n in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if op != "equal" for t in x[i:j] + y[k:n]]
        return bool(parts) and not any(re.match(r"\w", t) for t in parts)

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])
