"""Main text of web pages by the distribution of their line blocks.

Markup is stripped to lines, one for each block element. What markup itself names
as no article (menus, footers, adverts, forms, comments, ...) leaves no text, and
from one section to the next, unless one holds the other, there are blank lines.
The lengths of text outside links are summed over sliding windows of WINDOW
lines. Text surges where a sum leaves zero and dives where it is zero again; of
the stretches from surge to dive those are kept whose highest sum comes near the
page's, and what shares their section. Where markup names the article, sections
inside it leave no blank lines, and what lies outside isn't looked at.

Cases: null and empty html, and pages without text, give an empty text; very
long and truncated pages are read whole, unclosed elements end with their parent,
an unclosed quote with its tag;
of equal peaks all stretches are kept; repeated rows each have their result, also
those without page_id or url; an empty table gives an empty one; only ``page_id``,
``url`` and ``html`` are read.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks, texts_of

#: Lines in a window. A stretch is kept if its highest sum is this share of the page's highest, or that many characters.
WINDOW, SHARE, ENOUGH = 3, 0.25, 200

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # comments
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)>"  # tags
    r"|<[!?/][^>]*>"  # declarations
    r"|<[a-zA-Z!?/][^>]*\Z",  # what is cut off
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"[\s\"'/](class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=[\s/]|\Z))", re.IGNORECASE)

# Elements of HTML, by what they do to text.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style title textarea xmp iframe noembed noframes noscript template svg canvas audio video object dialog button select datalist label nav footer aside form menu".split())
SECTIONS = frozenset("html body main article section div table form header footer nav aside dialog menu".split())
BLOCKS = SECTIONS | frozenset("address blockquote center dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr legend li ol optgroup option p pre search summary tbody tfoot thead tr ul caption".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# Words in names of classes and ids. The first name parts that may also wrap an article, the second what never does.
LAYOUT = frozenset("nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs header masthead topbar footer foot bottombar sidebar aside rail widget widgets toolbar pagination pager search login copyright imprint legal skip form".split())
EXTRAS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner comment comments reply replies respond disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay toast newsletter subscribe subscription signup share sharing social related recommend recommended recommendation recommendations trending".split())
TEXTUAL = frozenset("content article main post entry story body text".split())
ROLES = {"navigation": "layout", "banner": "layout", "contentinfo": "layout", "complementary": "layout", "search": "layout", "form": "layout", "menu": "layout", "menubar": "layout", "alert": "extra", "alertdialog": "extra", "dialog": "extra", "main": "main", "article": "article"}


@functools.lru_cache(50_000)
def told_by(name: str, attributes: str) -> str:
    """What the attributes of an element say that it is: extra, layout, header, article, main or nothing."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found and found["hidden"].lower() != "false" or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
        return "extra"
    if role := ROLES.get(found.get("role", "").lower()):
        return role
    if found.get("itemprop", "").lower() == "articlebody":
        return "article"
    if name in ("html", "body", "main"):
        return ""
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    if name == "article":
        return "extra" if any(x.lower() in EXTRAS for x in names) else ""
    kinds = set()
    for x in names:
        words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", x)}
        if words and words <= TEXTUAL:
            return ""
        if not words & {"no", "has", "with", "without", "is"}:
            kinds |= {"extra"} if words & EXTRAS else {"header"} if words & LAYOUT == {"header"} else {"layout"} if words & LAYOUT else set()
            if "header" in kinds and words & TEXTUAL:
                kinds.discard("header")
    return next((k for k in ("extra", "layout", "header") if k in kinds), "")


@dataclass
class Element:
    name: str
    at: int  # number of the section it opens or lies in
    kind: str = ""  # why its text goes: hard, named, layout, extra
    article: int = 0  # number of the article it opens
    wraps: bool = False  # an article or main lies in it
    closed: bool = False
    parts: list[Element] = field(default_factory=list)  # the dropped elements round it, and itself

    def gone(self) -> bool:
        """Layouts that wrap the article keep their text, as do menus, adverts and the like that were never closed before it."""
        return self.kind == "hard" or not (self.wraps and (self.kind == "layout" or not self.closed))


@dataclass
class Line:
    text: str
    weight: int
    section: int
    parts: list[Element]
    mark: tuple[str, int]  # ("article" or "main" or "", number)


class Stripped:
    """The lines of a page, and the sections that hold each other."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.parent: list[int] = [0]
        self.whole = {0}
        self.words: list[str] = []
        self.weight = self.breaks = self.marks = 0
        self.open: Counter = Counter()
        self.stack = [Element("", 0)]
        self.marked: list[tuple[str, int]] = [("", 0)]
        self.read(page)

    def read(self, page: str) -> None:
        at = 0
        while at < len(page):
            m = TOKEN.search(page, at)
            stop = m.start() if m else len(page)
            if stop > at:
                self.text(page[at:stop])
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self.end(name)
            else:
                self.start(name, m[3])
                if name in RAW:
                    close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
                    at = close.start() if close else len(page)
        self.line()
        while len(self.stack) > 1:
            self.pop(False)

    def text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.words.append(text)
        if text.strip():
            self.breaks = 0
            if not self.open["a"] or self.marked[-1][0]:
                self.weight += len(text.strip())

    def line(self) -> None:
        """What was gathered since the last line is one."""
        text = " ".join("".join(self.words).split()) if self.words else ""
        if text:
            self.lines.append(Line(text, self.weight, self.stack[-1].at, self.stack[-1].parts, self.marked[-1]))
        self.words, self.weight, self.breaks = [], 0, 0

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.breaks += 1
            self.words.append(" ")
            if self.breaks > 1:
                self.line()
            return
        if name in ("td", "th"):
            self.words.append(" ")
        if name in BLOCKS:
            self.line()
            self.close({"p"})
        if name in SIBLINGS:
            self.close(SIBLINGS[name])
        if name in VOID:
            return
        if name == "a":
            self.close({"a"})
        top, kind = self.stack[-1], told_by(name, attributes)
        mark = name if name in ("article", "main") else kind if kind in ("article", "main") else ""
        if name == "header" and not kind:
            kind = "header"
        if kind == "header":
            kind = "" if self.marked[-1][0] == "article" else "layout"
        if name in DROPPED and kind not in ("extra", "article", "main"):
            kind = "layout" if name == "form" else "named" if name in ("nav", "footer", "aside", "menu") else "hard"
        element = Element(name, top.at, kind if kind not in ("article", "main") else "", parts=top.parts)
        if name in SECTIONS:
            element.at = len(self.parent)
            self.parent.append(top.at)
            if name in ("html", "body"):
                self.whole.add(element.at)
        if element.kind:
            element.parts = [*top.parts, element]
        elif mark:
            for x in top.parts:
                x.wraps = True
        if mark and not element.kind:
            self.marks += 1
            element.article = self.marks
            self.marked.append((mark, self.marks))
        self.stack.append(element)
        self.open[name] += 1

    def pop(self, closed: bool) -> None:
        x = self.stack.pop()
        x.closed = closed
        self.open[x.name] -= 1
        if x.article:
            self.marked.pop()

    def close(self, names: set[str]) -> None:
        """End the innermost open element of these names, not beyond the section."""
        if any(self.open[n] for n in names):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].name in names:
                    while len(self.stack) > i:
                        self.pop(True)
                    return
                if self.stack[i].name in SECTIONS:
                    return

    def end(self, name: str) -> None:
        if name in BLOCKS or name == "p":
            self.line()
        if name not in SECTIONS:
            self.close({name})
        elif self.open[name]:
            while self.stack[-1].name != name:
                self.pop(False)
            self.pop(True)

    def inside(self, section: int, outer: int) -> bool:
        while section > outer:
            section = self.parent[section]
        return section == outer


def stretches(weights: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(surge, dive, highest sum) of every run of lines without WINDOW lines in a row that weigh nothing."""
    heavy = np.flatnonzero(weights)
    if not len(heavy):
        return
    sums = np.convolve(weights, np.ones(WINDOW, "i8"))[WINDOW - 1 :]  # of each line and those that follow
    for run in np.split(heavy, np.flatnonzero(np.diff(heavy) > WINDOW) + 1):
        yield int(run[0]), int(run[-1]) + 1, int(sums[max(0, run[0] - WINDOW + 1) : run[-1] + 1].max())


def main_text(page: str) -> str:
    """The blocks of a page's article, two newlines between them."""
    found = Stripped(page)
    lines = [x for x in found.lines if not any(p.gone() for p in x.parts)]
    for mark in ("article", "main"):
        if any(x.mark[0] == mark for x in lines):
            lines = [x for x in lines if x.mark[0] == mark]
            break
    spread: list[Line | None] = []
    for i, x in enumerate(lines):
        old = lines[i - 1]
        if i and (x.mark != old.mark or not x.mark[0] and not found.inside(x.section, old.section) and not found.inside(old.section, x.section)):
            spread += [None] * WINDOW
        spread.append(x)
    runs = list(stretches(np.array([x.weight if x else 0 for x in spread], "i8")))
    if not runs:
        return ""
    least = min(ENOUGH, SHARE * max(r[2] for r in runs))
    high = [r for r in runs if r[2] >= least]
    home = spread[high[0][0]].section
    for a, *_ in high:
        while not found.inside(spread[a].section, home):
            home = found.parent[home]
    if home not in found.whole:
        first, last = min(r[0] for r in high), max(r[1] for r in high)
        high = [r for r in runs if r in high or first < r[0] < last or found.inside(spread[r[0]].section, home)]
    return "\n\n".join(x.text for a, z, _ in high for x in spread[a:z] if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 8 << 20, "html"):
            texts = [main_text(x) for x in texts_of(b, "html")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
