import hashlib
import html as entities
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, codes, maintext
from tessera.llm import queries as Q

SF = "/root/testdata/sf0.001"


def marked_article(page):
    """What a plain reading of the driver's pages gives: paragraphs between the article's tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    return "\n\n".join(t for t in (" ".join(entities.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts) if t)


def test_every_page_equals_its_marked_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = Q.op11_main_text(spark, SF)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == marked_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PROSE = ["It was late when the last of the boats came in, and nobody on the quay had eaten since noon.", "Short one.", "The harbour master counted them twice, wrote the number down and went home without a word."]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
WANT = "\n\n".join(PROSE)


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><div id='header'>My site</div><div class='menu'><ul><li><a href=/>Home</a><li>About</ul></div><div class='entry'>{BODY}</div><div class='sidebar'>All about me and what I like to read on long evenings</div><div id='comments'><p>I disagree with all that was said here, and will say so at great length, again and again, until it ends.</p></div><div id='footer'>2024</div></body></html>",
        f"<body><nav><a href=a>A</a></nav><main>{BODY}<aside>Aside</aside></main><footer>f</footer>",
        f"<body><form action=x><div class='has-sidebar page'><article>{BODY}<form>Mail <input> <button>Go</button></form></article></div></form></body>",
        f"<div role=banner>Banner</div><div role=main>{BODY}</div><div role='contentinfo'>c</div>",
        f"<article>{BODY}<section id=comments><article class=comment><p>Nice</p></article></section></article>",
        f"<nav><ul><li>never closed<article>{BODY}</article>",
        f"<div class=cookie-notice>We use cookies. Do you agree to all of them, on all our sites, for ever?</div><div>{BODY}</div><div hidden>not seen</div><div style='display: none'>neither</div>",
        f"<script>var a = '<p>no</p>';</script><style>p {{}}</style><!-- <p>no</p> --><article>{BODY}</article><script>document.write('x')",
        f"<table><tr><td><a href=1>One</a> <a href=2>Two</a></table><div>{BODY}</div><ul><li><a href=3>Three</a></ul>",
        "<div>" + BODY.replace("<p>", "<div>").replace("</p>", "</div>") + "</div><div>Made by us</div>",
    ],
)
def test_main_text_leaves_out_what_is_no_article(page):
    assert maintext.main_text(page) == WANT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   \n", ""),
        ("<p>", ""),
        ("<nav>menu</nav><footer>foot</footer>", ""),
        ("plain words", "plain words"),
        ("<p>a &amp; b &lt;c&gt; &eacute;&#233;&#xe9; &nbsp; d &am</p>", "a & b <c> ééé d &am"),
        ("<p>one\n\t two<br>three<b>bold</b>er<p>four", "one two threebolder\n\nfour"),
        ("<p>one<br><br>two", "one\n\ntwo"),
        ("<p>1 < 2 and 3<4</p>", "1 < 2 and 3<4"),
        ('<p title="a > b">x</p><p title=">y', "x\n\ny"),
        ("<h1>Title</h1><p>Text", "Title\n\nText"),
        ("<article><header><h1>T</h1></header><p>x<p class=ad>buy<p>y<footer>f</footer></article>", "T\n\nx\n\ny"),
        ("<ul><li>a<li>b</ul><p>c", "a\n\nb\n\nc"),
    ],
)
def test_blocks_and_references(page, text):
    assert maintext.main_text(page) == text


def test_stretches_end_where_a_window_weighs_nothing():
    assert list(maintext.stretches(np.array([0, 5, 0, 0, 7, 0, 0, 0, 9, 9]))) == [(1, 5, 7), (8, 10, 18)]
    assert list(maintext.stretches(np.array([], "i8"))) == []
    for seed in range(30):  # against windows summed one by one
        w = np.array([random.Random(seed * 99 + i).choice([0, 0, 0, 4, 50]) for i in range(40)])
        inside = [any(w[i : i + 1]) or (any(w[max(0, i - 2) : i]) and any(w[i + 1 : i + 3]) and any(all_zero_free(w, i))) for i in range(40)]
        assert [i for a, z, _ in maintext.stretches(w) for i in range(a, z)] == [i for i in range(40) if inside[i]]


def all_zero_free(w, i):
    """Whether a zero line lies in no run of WINDOW zero lines."""
    a, z = i, i
    while a > 0 and not w[a - 1]:
        a -= 1
    while z < len(w) - 1 and not w[z + 1]:
        z += 1
    return [a > 0 and z < len(w) - 1 and z - a + 1 < maintext.WINDOW]


def test_pages_with_odd_rows(spark):
    long = "<p>" + "word " * 200_000 + "</p>" + "<div>" * 3000
    rows = [(None, None, None, 1), (1, "u", "<p>x", 2), (1, "u", "<p>x", 2), (2, "v", "", 3), (3, None, long, 4)]
    got = maintext.extract(spark.createDataFrame(rows, "page_id int, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 999_999)]
    assert maintext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def kept_ints(rows, dim):
    out = []
    for vec_id, v, label in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            out.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], label))
    return out


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def brute_clusters(rows, k, rounds):
    kept = kept_ints(rows, 64)
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [list(v) for _, v, _ in sorted(kept, key=key)[:k]]
    near = lambda v: min(range(len(cents)), key=lambda c: (apart(v, cents[c]), c))
    for _ in range(rounds):
        at = [near(v) for _, v, _ in kept]
        for c in range(len(cents)):
            mine = [v for (_, v, _), a in zip(kept, at, strict=True) if a == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = [(near(v), apart(v, cents[near(v)])) for _, v, _ in kept]
    sums = {c: sum(d for a, d in at if a == c) for c in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((r[0] is None, r[0] or 0, c, d, sums[c], sum(sums.values()), digest[c]) for r, (c, d) in zip(kept, at, strict=True)))


def brute_codes(rows, entries, rounds):
    kept = kept_ints(rows, 64)
    cut = [[tuple(v[4 * p : 4 * p + 4]) for p in range(16)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[list(cut[i][p]) for i in order] for p in range(16)]
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (apart(x, books[p][e]), e))
    for _ in range(rounds):
        at = [[near(p, c[p]) for p in range(16)] for c in cut]
        for p in range(16):
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at, strict=True) if a[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = [[near(p, c[p]) for p in range(16)] for c in cut]
    error = [sum(apart(c[p], books[p][a[p]]) for p in range(16)) for c, a in zip(cut, at, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = lambda label: sum(e for e, r in zip(error, kept, strict=True) if r[2] == label)
    return sorted((r[0] is None, r[0] or 0, "".join(f"{x:02x}" for x in a), e, total(r[2]), digest) for r, a, e in zip(kept, at, error, strict=True))


def odd_vectors(n=120, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)], rng.choice([1, 2, None])) for i in range(n)]
    same = rows[3][1]
    rows += [(1000 + i, same, 7) for i in range(n // 2)]  # a third of all rows are one vector
    rows += [rows[5], rows[5], (5, rows[6][1], 2), (None, rows[7][1], None), (None, [0.5] * 64, 1)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.1] * 63, 1), (2003, [0.1] * 65, 1), (2004, [None] + [0.1] * 63, 1), (2005, [float("nan")] + [0.1] * 63, 1), (2006, [float("inf")] + [0.1] * 63, 1), (2007, [float("-inf")] * 64, 1)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int, code int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize(("n", "k", "rounds"), [(120, 40, 5), (20, 40, 2), (60, 3, 1)])
def test_clusters_equal_brute_force(spark, n, k, rounds):
    rows = odd_vectors(n)
    got = centroids.cluster(frame(spark, rows), k=k, rounds=rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got.collect()) == brute_clusters(rows, k, rounds)


@pytest.mark.parametrize(("n", "entries", "rounds"), [(120, 64, 2), (20, 64, 1), (60, 5, 3)])
def test_codes_equal_brute_force(spark, n, entries, rounds):
    rows = odd_vectors(n)
    got = codes.encode(frame(spark, rows), entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got.collect()) == brute_codes(rows, entries, rounds)


def test_screen_never_drops_the_nearest():
    rng = np.random.default_rng(3)
    for scale in (1, 50, 2**26):
        cents, v = rng.integers(-scale, scale + 1, (40, 64)), rng.integers(-scale, scale + 1, (700, 64))
        v[:40], v[40:80] = cents, cents[rng.integers(0, 40, 40)]
        cents[7] = cents[30]  # a tie
        screen = centroids.Screen(cents)
        norms = np.sqrt((v.astype("f8").reshape(len(v), 16, 4) ** 2).sum(2))
        at, d = screen.nearest(v, norms)
        every = ((v[:, None] - cents[None]) ** 2).sum(2)
        assert (at == every.argmin(1)).all() and (d == every.min(1)).all() and screen.compared <= every.size


def test_screen_spares_most_distances_where_vectors_cluster(spark):
    rng = np.random.default_rng(4)
    cents = rng.integers(-300, 300, (40, 64))
    v = cents[rng.integers(0, 40, 2000)] + rng.integers(-20, 21, (2000, 64))
    screen = centroids.Screen(cents)
    screen.nearest(v, np.sqrt((v.astype("f8").reshape(len(v), 16, 4) ** 2).sum(2)))
    assert screen.compared < 0.1 * 2000 * 40


def test_empty_and_too_large(spark):
    none = spark.createDataFrame([(1, None, None)], "vec_id long, embedding array<float>, label int")
    for df in (none, none.limit(0)):
        assert centroids.cluster(df).count() == 0 and codes.encode(df).count() == 0
        assert centroids.cluster(df).columns[0] == codes.encode(df).columns[0] == "vec_id"
    large = spark.createDataFrame([(1, [1e30] * 64, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="isn't below"):
        centroids.cluster(large).select(F.sum("distance")).collect()
