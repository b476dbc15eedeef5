"""Markdown into units: clauses between their markers, and rows of marked tables.

A marker is a comment ``<!-- DOC-ID:local -->`` (``clause:`` may stand before it),
a table's is ``<!-- table: DOC-ID:T1 -->``. One pass over a document's lines holds
the stack of headings, the open clause and the open fence. Long documents are cut
at safe lines, where that state is known to be empty, and their pieces are
scanned by different tasks; what concerns a whole document (order, ids that
repeat, parents) is done afterwards by windows and a join.

Cases: a null text has no units; texts without markers neither; the same
document twice gives its units twice under one doc_id, as repeated ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.stages import kept

#: Characters from which on a document is cut.
LONG = 200_000

# The forms of markers, headings, fences and rows.
DOC = r"([A-Z]+-[A-Z]+-[A-Z]+-\d+|[A-Z]+-[A-Z]+-\d+)"
CLAUSE = re.compile(rf"<!--\s*(?:clause:\s*)?{DOC}:([^\s|>]+)\s*-->")
TABLE = re.compile(rf"<!--\s*table:\s*{DOC}:([^\s|>]+)\s*-->")
HEADING = re.compile(r"(#{1,6})\s+(.*)")
FENCE = re.compile(r"`{3,}|~{3,}")

# What local ids mean, and words of headings, the first that fits.
UNIT_KINDS = (
    (r"^App-[A-Z]\.F\d+$", "form_field"),
    (r"^App-[A-Z]\.", "appendix"),
    (r"^T\d+-\d+$", "table_row"),
    (r"^R\d+\.[A-Z]\d+$", "tariff_subrule"),
    (r"^R\d+\.\d+$", "tariff_subrule"),
    (r"^S\d+\.\d+$", "section"),
    (r"^S\d+\.[A-Z]+$", "other"),
    (r"^(OBL-\d+-\d+|EVT-\d+-\d+|RRS-[A-Z]+-\d+)$", "register_row"),
)
SECTION_KINDS = (
    ("purpose", "purpose"),
    ("scope", "scope"),
    ("definition", "definitions"),
    ("regulatory basis", "regulatory_basis"),
    ("regulatory framework", "regulatory_basis"),
    ("role", "roles"),
    ("responsibilit", "roles"),
    ("procedure", "procedure"),
    ("process", "procedure"),
    ("record", "records"),
    ("training", "training"),
    ("related document", "related_docs"),
    ("cross-reference", "related_docs"),
    ("revision history", "revision_history"),
    ("approval", "approval"),
    ("appendix", "appendix"),
    ("front-matter", "front_matter"),
)


def unit_kind(local_id: Column) -> Column:
    out = F.lit("section")
    for form, kind in reversed(UNIT_KINDS):
        out = F.when(local_id.rlike(form), kind).otherwise(out)
    return out


def section_kind(path: Column) -> Column:
    """By the last heading, else by the one above it."""

    def of(heading: Column) -> Column:
        return F.coalesce(*[F.when(F.contains(F.lower(heading), F.lit(word)), kind) for word, kind in SECTION_KINDS])

    return F.coalesce(of(F.try_element_at(path, F.lit(-1))), of(F.try_element_at(path, F.lit(-2))), F.lit("other"))


def parent_candidates(local_id: Column) -> Column:
    """The local ids that a clause may hang under, nearest first."""
    base = F.when(local_id.rlike(r"^\d.*[A-Za-z]$"), F.expr("substring(local_id, 1, length(local_id) - 1)")).otherwise(local_id)
    parts = F.split(base, r"\.")
    longer = F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")))
    head = F.regexp_extract(local_id, r"^(App-[A-Z]|R\d+)\.", 1)
    return F.when(base.rlike(r"^\d+(\.\d+)+$"), longer).when(head != "", F.array(head)).otherwise(F.array().cast("array<string>"))


@dataclass
class Open:
    """A clause whose end isn't known yet."""

    doc: str
    local: str
    start: int
    line: int
    path: list[str]


@dataclass
class Scan:
    """One pass over lines; units are (marker's document, local id, table, path, start, end, line, text, cells)."""

    text: str
    at: int = 0
    line: int = 0
    headings: list[tuple[int, str]] = field(default_factory=list)
    clause: Open | None = None
    fence: str = ""
    columns: list[str] | None = None  # of the table that is open; empty: its head is still to come
    table: tuple[str, str] = ("", "")

    def path(self) -> list[str]:
        return [h for _, h in self.headings]

    def closed(self, end: int) -> Iterator[tuple]:
        c, self.clause = self.clause, None
        if c:
            yield c.doc, c.local, None, c.path, c.start, end, c.line, self.text[c.start : end], None

    def units(self) -> Iterator[tuple]:
        for raw in self.text.splitlines(keepends=True):
            start, self.at = self.at, self.at + len(raw)
            yield from self.step(raw.rstrip("\r\n"), start)
            self.line += 1
        yield from self.closed(self.at)

    def step(self, line: str, start: int) -> Iterator[tuple]:
        if self.columns is not None:  # blank lines may come before a table's first row
            if line.startswith("|"):
                yield from self.row(line, start)
                return
            if line.strip() or self.columns:
                self.columns = None
            else:
                return
        if m := FENCE.match(line):
            if not self.fence:
                self.fence = m[0]
            elif line.startswith(self.fence):
                self.fence = ""
        elif self.fence:
            pass
        elif m := HEADING.match(line):
            yield from self.heading(len(m[1]), m[2].strip(), start)
        elif m := TABLE.search(line):
            yield from self.closed(start)
            self.table, self.columns = (m[1], m[2]), []
        elif m := CLAUSE.search(line):
            yield from self.closed(start)
            self.clause = Open(m[1], m[2], self.at, self.line + 1, self.path())

    def heading(self, level: int, text: str, start: int) -> Iterator[tuple]:
        ends = self.clause is not None and level <= (self.headings[-1][0] if self.headings else 0)
        blank = ends and not self.text[self.clause.start : start].strip()
        if ends and not blank:
            yield from self.closed(start)
        while self.headings and self.headings[-1][0] >= level:
            self.headings.pop()
        self.headings.append((level, text))
        if blank:  # a clause that has nothing yet goes on under the new heading
            self.clause.path = self.path()

    def row(self, line: str, start: int) -> Iterator[tuple]:
        cells = line.split("|")
        cells = [c.strip() for c in cells[not cells[0].strip() : len(cells) - (len(cells) > 1 and not cells[-1].strip())]]
        if cells and all(re.fullmatch(r"[-:]+", c) for c in cells if c):
            return
        if not self.columns:
            self.columns = cells or [""]
        elif cells:
            told = {h: c for h, c in zip(self.columns, cells, strict=False) if h and c}
            yield self.table[0], cells[0], self.table[1], self.path(), start, self.at, self.line, "\n".join(f"{h}: {c}" for h, c in zip(self.columns, cells, strict=False) if h and c), told


def safe_cuts(text: str, size: int) -> Iterator[tuple[int, int]]:
    """(place, line) from which on a scan needs nothing of what is before: level-one headings outside fences that aren't the first heading and don't follow a bare marker, at least size apart."""
    at, last, fence, seen, bare, table = 0, 0, "", False, False, False
    for n, raw in enumerate(text.splitlines(keepends=True)):
        line = raw.rstrip("\r\n")
        table = table and (line.startswith("|") or not line.strip())
        if table:
            pass
        elif m := FENCE.match(line):
            fence = m[0] if not fence else "" if line.startswith(fence) else fence
        elif not fence and (m := HEADING.match(line)):
            if len(m[1]) == 1 and seen and not bare and at - last >= size:
                yield at, n
                last = at
            seen = True
        elif not fence:
            table = bool(TABLE.search(line))
        if line.strip():
            bare = not fence and not table and bool(CLAUSE.search(line)) and not HEADING.match(line)
        at += len(raw)


PIECE = "doc_id string, n int, at long, line int, text string"
UNITS = "doc_id string, n int, i int, marker string, local_id string, table_id string, heading_path array<string>, char_start long, char_end long, line_start int, text_raw string, row_cells map<string,string>"
STRINGS = pa.list_(pa.string())
UNIT_SCHEMA = pa.schema([("doc_id", pa.string()), ("n", pa.int32()), ("i", pa.int32()), ("marker", pa.string()), ("local_id", pa.string()), ("table_id", pa.string()), ("heading_path", STRINGS), ("char_start", pa.int64()), ("char_end", pa.int64()), ("line_start", pa.int32()), ("text_raw", pa.string()), ("row_cells", pa.map_(pa.string(), pa.string()))])


def cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            marks = [(0, 0), *(safe_cuts(text, size) if len(text) > size else ())]
            out += [(doc, n, a, line, text[a:z]) for n, ((a, line), z) in enumerate(zip(marks, [*(m[0] for m in marks[1:]), len(text)], strict=True))]
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "n", "at", "line", "text"])


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[dict] = []
        for doc, n, at, line, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for i, (marker, local, table, path, a, z, first, raw, cells) in enumerate(Scan(text).units()):
                out.append({"doc_id": doc, "n": n, "i": i, "marker": marker, "local_id": local, "table_id": table, "heading_path": path, "char_start": at + a, "char_end": at + z, "line_start": line + first, "text_raw": raw, "row_cells": list(cells.items()) if cells is not None else None})
        yield pa.RecordBatch.from_pylist(out, schema=UNIT_SCHEMA)


def segments(docs: DataFrame, size: int = LONG) -> DataFrame:
    """The units of documents (doc_id string, text): doc_id, ordinal, clause_id, local_id, parent_clause_id, unit_kind, section_kind, table_id, heading_path, char_start, char_end, line_start, text_raw, text_sha256, row_cells.

    The n-th unit with an id that was there before has _r<n> behind it, a table's
    row the table's id and a number. A parent is the nearest of the ids that the
    local id points to which an earlier unit has.
    """
    pieces = docs.where("text is not null").select(F.col("doc_id").cast("string"), "text").mapInArrow(lambda it: cut(it, size), PIECE)
    # written once: numbering, parents and the result each read it, and would each scan all lines anew
    units = kept(pieces.repartition(F.col("doc_id"), F.col("n")).mapInArrow(scanned, UNITS))
    order = Window.partitionBy("doc_id").orderBy("n", "i")
    units = units.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).withColumn("full_id", F.concat_ws(":", "marker", "local_id"))
    again = F.row_number().over(Window.partitionBy("doc_id", "full_id").orderBy("ordinal")) > 1
    units = units.withColumn("again", again)
    nth = F.row_number().over(Window.partitionBy("doc_id", "full_id", "table_id", "again").orderBy("ordinal")) + 1
    mark = F.when(F.col("table_id").isNotNull(), F.concat(F.lit("_"), "table_id", F.lit("_"), nth.cast("string"))).otherwise(F.concat(F.lit("_r"), nth.cast("string")))
    units = units.withColumn("clause_id", F.concat("full_id", F.when(F.col("again"), mark).otherwise("")))
    first = units.where("not again").select("doc_id", F.col("full_id").alias("parent"), F.col("ordinal").alias("parent_at"))
    asked = units.select("doc_id", "ordinal", F.posexplode(parent_candidates(F.col("local_id"))).alias("far", "candidate")).withColumn("parent", F.concat_ws(":", "doc_id", "candidate"))
    found = asked.join(first, ["doc_id", "parent"]).where("parent_at < ordinal").groupBy("doc_id", "ordinal").agg(F.min_by("parent", "far").alias("parent_clause_id"))
    kind = F.when(F.col("table_id").isNotNull(), "table_row").otherwise(unit_kind(F.col("local_id")))
    return units.join(found, ["doc_id", "ordinal"], "left").select("doc_id", "ordinal", "clause_id", "local_id", "parent_clause_id", kind.alias("unit_kind"), section_kind(F.col("heading_path")).alias("section_kind"), "table_id", "heading_path", "char_start", "char_end", "line_start", "text_raw", F.sha2("text_raw", 256).alias("text_sha256"), "row_cells")
