"""Numbers in words, and values replaced in a text as they are written there."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

REPLACED = StructType().add("text", StringType()).add("old_form", StringType()).add("new_form", StringType())

# English number words.
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def words_of(n: int) -> str | None:
    """1 to 999 in words, tens hyphenated."""
    if not 1 <= n <= 999:
        return None
    hundreds, rest = divmod(n, 100)
    parts = [f"{ONES[hundreds]} hundred"] if hundreds else []
    if rest >= 20:
        parts.append(TENS[rest // 10 - 2] + (f"-{ONES[rest % 10]}" if rest % 10 else ""))
    elif rest:
        parts.append(ONES[rest])
    return " ".join(parts)


SMALL = {w: i for i, w in enumerate(ONES)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)}


def number_in(text: str | None) -> int | None:
    """The number that words say, below a million; None if they say none. "and" and hyphens may stand between."""
    words = [w for w in re.split(r"[\s-]+", (text or "").strip().lower()) if w and w != "and"]
    total, part = 0, None
    for w in words:
        if w in SMALL:
            part = (part or 0) + SMALL[w]
        elif w == "hundred" and part is not None:
            part *= 100
        elif w == "thousand" and part is not None:
            total, part = total + part * 1000, 0
        else:
            return None
    return total + part if part is not None else None


@F.arrow_udf(LongType())
def numbers_in(text: pa.Array) -> pa.Array:
    return pa.array([number_in(t) for t in text.to_pylist()], pa.int64())


@F.arrow_udf(StringType())
def in_words(n: pa.Array) -> pa.Array:
    return pa.array([None if x is None else words_of(x) for x in n.to_pylist()], pa.string())


def like(shape: str, word: str) -> str:
    """word in capitals, or with one, as shape is."""
    return word.upper() if len(shape) > 1 and shape.isupper() else word[0].upper() + word[1:] if shape[:1].isupper() else word


def replace_one(text: str, old: int, new: int, near: int | None) -> tuple[str, str, str] | None:
    """(text, old form, new form) with one place of a whole number replaced: word and numeral together, else a numeral, else a word; the one nearest to ``near``, else the first."""
    spelt, respelt = words_of(old), words_of(new)
    numeral = rf"(?<![\d.,\-§])\b{old}\b(?![\d\-]|[.,]\d)"
    forms = [(numeral, lambda m: str(new))]
    if spelt and respelt:
        forms.insert(0, (rf"(?i)\b({spelt})(\s*\(\s*){old}(\s*\))", lambda m: f"{like(m[1], respelt)}{m[2]}{new}{m[3]}"))
        forms.append((rf"(?i)\b{spelt}\b", lambda m: like(m[0], respelt)))
    for form, put in forms:
        if found := list(re.finditer(form, text)):
            m = found[0] if near is None else min(found, key=lambda m: abs(m.start() - near))
            return text[: m.start()] + put(m) + text[m.end() :], m[0], put(m)
    return None


@F.pandas_udf(REPLACED)
def replaced(text: pd.Series, old: pd.Series, new: pd.Series, near: pd.Series) -> pd.DataFrame:
    """replace_one() of every row; null where the value isn't in the text. near may be null."""
    rows = [replace_one(t, int(a), int(b), None if pd.isna(p) else int(p)) if isinstance(t, str) and not pd.isna(a) and not pd.isna(b) else None for t, a, b, p in zip(text, old, new, near, strict=True)]
    return pd.DataFrame([r or (None, None, None) for r in rows], columns=["text", "old_form", "new_form"])


def changed_value(n: Column) -> Column:
    """Half as much again, to even, at least one more."""
    return F.greatest(F.bround(n * 1.5, 0).cast("long"), n + 1)
