import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import licenses, quality, sketches, toxicity


def xx(*parts):
    """Spark's xxhash64 of several columns: each hash seeds the next."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def brute_base(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {k for places in at.values() if len(places) > 1 for i in places for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def grams(t):
    tokens = [xx(x) for x in re.findall(r"[^\W_]+|(?:[^\w\x20\x09-\x0D]|_)+", t or "")]
    return [h & (quality.BUCKETS - 1) for h in tokens + [xx(a, b) for a, b in zip(tokens, tokens[1:], strict=False)]]


def test_quality(spark):
    import math

    rng = random.Random(0)
    word = lambda: "".join(rng.choice("aeioustr") for _ in range(rng.randint(1, 6)))
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.randint(0, 60))]
        if i % 4 == 0:
            words = [w + "%%%" for w in words]
        if i % 5 == 0:
            words += words[:20]
        rows.append((i, rng.choice([" ", "\n", "\t \n"]).join(words)))
    rows += [(200, None), (201, ""), (202, " \n\x0b"), (203, "a b\n" * 30 + "\n\n \n"), (204, "x y\x00z " * 12), (205, "😀 é " * 11), (206, "w " * 3000)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(120)] + [(None, 1), (1, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    texts = dict(rows)
    raw, good = {}, {}
    for i, t in rows:
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            if i < 120 and i % 4:
                good[g] = good.get(g, 0) + 1
    n_raw, n_good, flat = sum(raw.values()), sum(good.values()), quality.BUCKETS
    for i, t in texts.items():
        r, base = got[i], brute_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base, i
        gs = grams(t)
        llr = sum(math.log((good.get(g, 0) + 1) / (n_good + flat)) - math.log((raw.get(g, 0) + 1) / (n_raw + flat)) for g in gs) / len(gs) if gs else 0
        assert abs(r.llr - llr) < 1e-6
        assert r.kept == (not base[5] and llr >= quality.THRESHOLD)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.judge(docs.where("false"), labels).count() == 0
    assert all(r.llr == 0 for r in quality.judge(docs.limit(3), labels.where("false")).collect())


def toy(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioustr") for _ in range(rng.randint(2, 6)))
    texts, toxic = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 150))]
        toxic.append(int(i % 3 == 0))
        if toxic[-1]:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty.", "Awful"]))
        texts.append(" ".join(words))
    return texts, toxic


def test_gradients():
    net = toxicity.Network({"a": 1, "b": 2}, np.array([0, 1.0, -1.0], "f4"))
    for k in net.p:
        net.p[k] = net.p[k].astype("f8")
    word_rows, tri, sizes = net.features(["a", "b", "ccc"])
    at = np.array([[0, 1, 2, 1, 3, 3], [2, 2, 0, 1, 0, 2]])
    y = np.array([1.0, 0.0])

    def loss():
        e = np.concatenate([net.embed(word_rows, tri, sizes) @ net.p["enter"] + net.p["bias"], np.zeros((1, 6 * toxicity.HIDDEN))])
        s = net.forward(e, at)
        return e, -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum()

    e, _ = loss()
    score, kept = net.forward(e, at, keep=True)
    grad, d_in = net.backward(at, len(e), kept, score - y)
    grad["bias"] = d_in[:3].sum(axis=0)
    rng = np.random.default_rng(0)
    for name, g in grad.items():
        for _ in range(4):
            i = tuple(rng.integers(n) for n in net.p[name].shape)
            old = net.p[name][i]
            net.p[name][i] = old + 1e-4
            up = loss()[1]
            net.p[name][i] = old - 1e-4
            down = loss()[1]
            net.p[name][i] = old
            assert abs((up - down) / 2e-4 - g[i]) < 2e-3 * max(1, abs(g[i])), name


def test_inference_is_the_forward_pass():
    net = toxicity.Network({"a": 1}, np.zeros(2, "f4"))
    rng = np.random.default_rng(1)
    e = net.entered(rng.standard_normal((40, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype("f4"))
    at = rng.integers(0, 41, (30, toxicity.WINDOW))
    assert np.abs(net.forward(e, at) - net.infer(e, at)).max() < 1e-5


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 111, 112, 113, 1000):
        at = toxicity.windows_of(np.arange(n), -1)
        assert set(at.ravel().tolist()) - {-1} == set(range(n))


def test_toxicity_is_learnt(spark):
    texts, toxic = toxy = toy(420, 1)
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, "word " * 5000 + "vile nasty awful " + "word " * 5000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*enumerate(toxic), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [i for i in range(len(texts)) if got[i].held_out]
    assert 100 < len(held) < 180
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.95
    assert got[1002].predicted == 1 and got[1000].score == got[1001].score and got[1001].predicted == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert [r.score for r in toxicity.score_documents(docs.limit(2), labels.where("false")).collect()] == [0.0, 0.0]
    assert toxicity.score_documents(docs.where("false"), labels).count() == 0
    assert toxy


def test_training_takes_one_row_of_a_doc_id(spark):
    docs = spark.createDataFrame([(i % 20, f"text number {i}") for i in range(400)], "doc_id long, text string")
    texts, toxic = toxicity.training_rows(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int"))
    assert 0 < len(texts) == len(set(texts)) <= 20 and len({int(t.split()[-1]) % 20 for t in texts}) == len(texts) == len(toxic)


def test_licenses(spark):
    body = "Some words before.\n{}\nand after it."
    texts = {
        1: body.format("Released under the MIT License."),
        2: body.format("This work is licensed under the GNU General Public License, version 2."),
        3: body.format("This work is licensed under the GNU General Public License, version 3."),
        4: body.format(licenses.TEMPLATES["BSD-3-Clause"].replace("source code", "the code").replace(". ", ".\n")),
        5: "no notice here, only a driving licence that was lost",
        6: "",
        7: None,
        8: "x " * 40_000 + licenses.TEMPLATES["Apache-2.0"] + " y" * 40_000,
        9: licenses.TEMPLATES["CC-BY-NC-4.0"] + "\n" * 5 + licenses.TEMPLATES["MIT"],
    }
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(1, texts[1], 1)], "doc_id long, text string, block int")
    got = licenses.scan(df).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
        assert texts[r.doc_id][r.start : r.stop]
    assert {i: sorted({r.license_id for r in x}) for i, x in by_id.items()} == {1: ["MIT-short"], 2: ["GPL-2.0-short"], 3: ["GPL-3.0-short"], 4: ["BSD-3-Clause"], 8: ["Apache-2.0"], 9: ["CC-BY-NC-4.0", "MIT"]}
    assert len(by_id[1]) == 2 and by_id[1][0].alike == 1 and by_id[1][0].template_bytes < by_id[1][0].plain_bytes
    assert "source" in by_id[4][0].lacks and "the" in by_id[4][0].adds
    assert licenses.scan(df.where("false")).count() == 0


def test_licenses_wrapped_or_adjacent(spark):
    import textwrap

    names = ["MIT", "BSD-3-Clause", "GPL-3.0", "Apache-2.0", "Unlicense"]
    texts = {i: ("Some words before. " * 30 + "\n" + textwrap.fill(licenses.TEMPLATES[n], 80) + "\n" + "and words after " * 30) for i, n in enumerate(names)}
    texts[10] = licenses.TEMPLATES["MIT-short"] + "\n" + licenses.TEMPLATES["Apache-2.0-short"]
    texts[11] = textwrap.fill(licenses.TEMPLATES["MIT"], 72) + "\n" + textwrap.fill(licenses.TEMPLATES["BSD-3-Clause"], 72)
    texts[12] = textwrap.fill(licenses.TEMPLATES["GPL-3.0"].replace("redistribute", "share").replace("GNU", "gnu the"), 40).replace("\n", "\n * ")
    found = {}
    for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append(r.license_id)
    assert {i: sorted(x) for i, x in found.items()} == {i: [n] for i, n in enumerate(names)} | {10: ["Apache-2.0-short", "MIT-short"], 11: ["BSD-3-Clause", "MIT"], 12: ["GPL-3.0"]}


def brute_sets(t):
    return set(sketches.digests(t).tolist())


def test_sketches(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé😀") for _ in range(rng.randint(1, 5)))
    rows = [(i * 7 % 300, rng.choice([" ", "\n"]).join(word() for _ in range(rng.randint(0, 120)))) for i in range(300)]
    rows[10] = (rows[10][0], rows[20][1])
    rows += [(400, None), (401, ""), (402, "x" * 50_000), (403, "a b c " * 4000), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int")
    got = {r.doc_id: r for r in sketches.compare_versions(df, rows_of_task=23).collect()}
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -(r[0] if r[0] is not None else -1))
    prints = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = brute_sets(t), brute_sets(other)
            assert abs(near - (1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1)) < 1e-9
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    lone = sketches.compare_versions(df.where("doc_id = 402")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1
    assert sketches.compare_versions(df.where("false")).count() == 0


@pytest.mark.parametrize("base", [0, 7 * 10**17, -(2**62), 2**63 - 4000])
def test_sketches_of_long_ids(spark, base):
    """Boundaries between tasks are exact for any long; likenesses follow from the returned strings alone."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6)))
    rows = [(base + 3 * i, " ".join(word() for _ in range(rng.randint(0, 90)))) for i in range(200)]
    rows += [(base + 31, "same id " * n) for n in range(20)] + [(base + 32, "same row")] * 3
    got = sketches.compare_versions(spark.createDataFrame(rows, "doc_id long, text string"), rows_of_task=20).collect()
    assert len(got) == len(rows)
    shas = {(r.doc_id, r.edited_sha256) for r in got}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)]
        if i in (base + 31, base + 32) or after[0] in (base + 31, base + 32):
            continue
        n = len(t) // 3
        assert (i, hashlib.sha256((t[: len(t) - n] + after[1][:n]).encode()).hexdigest()) in shas
    prints = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(order):
        r, after = prints[i], prints[order[(k + 1) % len(order)][0]]
        assert r.near_edited == sketches.likeness_of(r.fingerprint, r.edited_fingerprint)
        if base + 32 not in (i, after.doc_id) and base + 31 not in (i, after.doc_id):
            assert r.near_next == sketches.likeness_of(r.fingerprint, after.fingerprint)


def test_fingerprints_compare_at_any_size():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6)))
    for n, m in ((0, 0), (0, 50), (3, 4000), (2000, 2000), (1, 1)):
        a, b = (" ".join(word() for _ in range(k)) for k in (n, m))
        b = a[: len(a) // 2] + b
        x, y = brute_sets(a), brute_sets(b)
        left, right = sketches.fingerprints(sketches.sets_of([a, b]))
        assert sketches.likeness_of(left, right) == (1 - len(x ^ y) / (len(x) + len(y)) if x or y else 1)
        assert sketches.likeness_of(left, left) == 1


def test_licenses_are_ranked_by_what_they_save():
    """Every template with words changed: of those whose wording fits, the one that saves most wins."""
    rng, changed = random.Random(8), 0
    for name, template in licenses.TEMPLATES.items():
        for share in (0, 0.05, 0.1):
            words = [w if rng.random() >= share else rng.choice(["zebra", "the", "quickly", "of"]) for w in licenses.words_of(template)]
            plain = licenses.size(words)
            order = sorted(licenses.TEMPLATES, key=lambda t: (licenses.size(words, t) - plain, t))
            fits = [t for t in order if (m := licenses.best_match(licenses.words_of(licenses.TEMPLATES[t]), words)) and m[0] >= licenses.MIN_ALIKE and plain - licenses.size(words, t) >= licenses.MIN_BYTES]
            got = licenses.notices(" ".join(words))
            if not fits:
                assert not got or len(words) < 12 or got[0][6] >= licenses.MIN_ALIKE
                continue
            best = max(got, key=lambda n: n[1] - n[0])
            assert best[2] == fits[0], (name, share, best[2], fits[:3])
            changed += share > 0
    assert changed > 30


def test_every_template_is_found_in_prose():
    for name, template in licenses.TEMPLATES.items():
        text = "some words before it, " * 20 + template + " and other words that follow, " * 20
        found = [n for n in licenses.notices(text)]
        assert [n[2] for n in found] == [name] and found[0][6] == 1 and not found[0][7] and not found[0][8]
        assert licenses.words_of(text[found[0][0] : found[0][1]]) == licenses.words_of(template)


def test_equal_savings_go_by_name(monkeypatch):
    twins = {"b-twin": licenses.TEMPLATES["ISC"], "a-twin": licenses.TEMPLATES["ISC"]}
    monkeypatch.setattr(licenses, "TEMPLATES", twins)
    licenses.compressors.cache_clear()
    licenses.pairs_of_templates.cache_clear()
    try:
        assert [n[2] for n in licenses.notices(twins["b-twin"] + " word " + twins["b-twin"])] == ["a-twin", "a-twin"]
    finally:
        licenses.compressors.cache_clear()
        licenses.pairs_of_templates.cache_clear()


def test_warranty_and_file_lines(spark):
    text = "// SPDX-License-Identifier: Apache-2.0\n" + licenses.TEMPLATES["MIT"].upper() + "\n\n" + licenses.TEMPLATES["MIT-warranty"].upper().replace(" ", "\n")
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [r.license_id for r in got] == ["SPDX-Apache-2.0", "MIT", "MIT-warranty"]
