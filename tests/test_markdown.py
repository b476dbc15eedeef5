"""The segmenter against a plain walk over whole documents."""

import random
import re

import pytest

from tessera.plans.landing import as_markdown
from tessera.sources import markdown

MARK = r"([A-Z]+-[A-Z]+(?:-[A-Z]+)?-\d+):([^\s|>]+)\s*-->"


def walk(doc_id, text, offset=0):
    """(id, parent, table, path, start, end, text) of each unit, line by line with all ids seen so far."""
    units, seen, path, clause, fence, i = [], set(), [], None, None, 0
    lines = text.splitlines(keepends=True)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x))

    def parent(local):
        base = local[:-1] if re.match(r"\d", local) and local[-1].isalpha() else local
        tries = []
        if re.fullmatch(r"\d+(\.\d+)+", base):
            bits = base.split(".")
            tries = [".".join(bits[:k]) for k in range(len(bits) - 1, 0, -1)]
        elif m := re.match(r"(App-[A-Z]|R\d+)\.", local):
            tries = [m[1]]
        return next((f"{doc_id}:{t}" for t in tries if f"{doc_id}:{t}" in seen), None)

    def add(doc, local, table, where, a, z, body):
        name, n = f"{doc}:{local}", 2
        if name in seen:
            while (new := f"{name}_{table}_{n}" if table else f"{name}_r{n}") in seen:
                n += 1
            name = new
        units.append((name, parent(local), table, tuple(where), a, z, body))
        seen.add(name)

    def close(z):
        nonlocal clause
        if clause:
            add(clause[0], clause[1], None, clause[3], clause[2], z, text[clause[2] : z])
        clause = None

    while i < len(lines):
        line, a, z = lines[i].rstrip("\r\n"), starts[i], starts[i + 1]
        i += 1
        if m := re.match(r"`{3,}|~{3,}", line):
            fence = m[0] if fence is None else None if line.startswith(fence) else fence
            continue
        if fence is not None:
            continue
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            level = len(m[1])
            keep = [p for p in path if p[0] < level] + [(level, m[2].strip())]
            if clause and level <= (path[-1][0] if path else 0):
                if text[clause[2] : a].strip():
                    close(a)
                else:
                    clause = (*clause[:3], [t for _, t in keep])
            path = keep
        elif m := re.search(r"<!--\s*table:\s*" + MARK, line):
            close(a)
            while i < len(lines) and not lines[i].strip():
                i += 1
            head = None
            while i < len(lines) and lines[i].startswith("|"):
                cells = [c.strip() for c in lines[i].rstrip("\r\n").split("|")][1:]
                cells = cells[:-1] if cells and not cells[-1] else cells
                if cells and all(re.fullmatch("[-:]+", c) for c in cells if c):
                    pass
                elif not head:
                    head = cells
                elif cells:
                    add(m[1], cells[0], m[2], [t for _, t in path], starts[i], starts[i + 1], "\n".join(f"{h}: {c}" for h, c in zip(head, cells) if h and c))
                i += 1
        elif m := re.search(r"<!--\s*(?:clause:\s*)?" + MARK, line):
            close(a)
            clause = (m[1], m[2], z, [t for _, t in path])
    close(len(text))
    return units


def random_markdown(rng, doc):
    lines = []
    for _ in range(rng.randint(0, 120)):
        what = rng.randint(0, 13)
        if what < 3:
            lines.append("#" * rng.randint(1, 4) + " " + rng.choice(["Purpose", "Scope and roles", "Odd", "Training"]))
        elif what < 6:
            local = rng.choice(["1", "1.1", "1.1.2", "2.3a", "App-A", "App-A.F1", "R01", "R01.2", "S1.2", "odd!"])
            lines.append(f"<!-- {rng.choice(['', 'clause: '])}{rng.choice([doc, 'ACM-X-1'])}:{local} -->")
        elif what == 6:
            lines.append(rng.choice(["```", "~~~", "````python", "```mermaid"]))
        elif what == 7:
            lines += [f"<!-- table: {doc}:T{rng.randint(1, 2)} -->", *[""] * rng.randint(0, 2), "| ID | What |", "| --- | :-: |", *[f"| {rng.choice('abc')} | {rng.choice(['x', '', 'y | z'])} |" for _ in range(rng.randint(0, 3))]]
        else:
            lines.append(rng.choice(["", "Some words.", "   ", "- a list", "| not a table |"]))
    return rng.choice(["\n", "\r\n"]).join(lines)


FIELDS = ("clause_id", "parent_clause_id", "table_id", "heading_path", "char_start", "char_end", "text_raw")


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.ordinal)):
        out.setdefault(r.doc_id, []).append(tuple(tuple(v) if isinstance(v := r[f], list) else v for f in FIELDS))
    return out


@pytest.mark.parametrize("size", [markdown.LONG, 60])
def test_units_equal_a_plain_walk(spark, size):
    """Also where documents are cut at every safe line."""
    rng = random.Random(size)
    docs = {f"ACM-CS-{i}": random_markdown(rng, f"ACM-CS-{i}") for i in range(150)}
    want = {k: u for k, t in docs.items() if (u := walk(k, t))}
    got = rows_of(markdown.segments(spark.createDataFrame(list(docs.items()), "doc_id string, text string"), size))
    assert got == want and sum(map(len, want.values())) > 1000


def test_documents_as_markdown_equal_a_plain_walk(spark):
    docs = as_markdown(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {k: u for k, t in texts.items() if (u := walk(k, t))}
    assert rows_of(markdown.segments(docs, 2000)) == want and len(want) > 100


def test_cuts_leave_whole_documents():
    rng, n = random.Random(1), 0
    for _ in range(200):
        text = random_markdown(rng, "ACM-CS-1")
        cuts = [a for a, _ in markdown.safe_cuts(text, 1)]
        n += len(cuts)
        assert all(text[a] == "#" for a in cuts)
    assert n > 100


def test_kinds_and_nulls(spark):
    text = "# Roles and Responsibilities\n## x\n<!-- ACM-A-1:R01.D01 -->\nwords\n## Appendix\n<!-- ACM-A-1:App-B.F2 -->\n"
    rows = markdown.segments(spark.createDataFrame([("ACM-A-1", text), ("b", None), ("c", "")], "doc_id string, text string")).collect()
    assert sorted((r.local_id, r.unit_kind, r.section_kind) for r in rows) == [("App-B.F2", "form_field", "appendix"), ("R01.D01", "tariff_subrule", "roles")]
    assert markdown.segments(spark.createDataFrame([], "doc_id string, text string")).count() == 0
