import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import inclusion, similar


def texts(rng, n):
    """Random texts, copies and edits of them, in three blocks; one line is everywhere."""
    out, common = [], " ".join(f"common{i}" for i in range(12))
    for i in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out)[2].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
        else:
            words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 3, 6, 30, 60]))] + common.split(" ")
        out.append((rng.choice("ab"), i, " ".join(words)))
    return out


def grams(text):
    w = text.split(" ")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def frame(spark, rows):
    return spark.createDataFrame(rows, "block string, key long, text string")


def sets(spark, rows):
    return similar.shingle_sets(frame(spark, rows), "block", "key", F.split("text", " "))


def test_similar_finds_every_pair(spark):
    rows = texts(random.Random(1), 150)
    want = {(a[1], b[1]): alike(a[2], b[2]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and alike(a[2], b[2]) >= 0.8}
    got = {(r.a, r.b): r.score for r in similar.similar(sets(spark, rows)).collect()}
    assert got == pytest.approx(want) and len(want) > 100


def test_best_of_others_between_two_tables(spark):
    rng = random.Random(2)
    old = texts(rng, 120)
    new = [(b, k + rng.choice([0, 0, 1000]), t if rng.random() < 0.5 else t + " more") for b, k, t in old]
    want = {}
    for b, k, t in new:
        found = [(-alike(t, u), j) for c, j, u in old if c == b and j != k and alike(t, u) >= 0.8]
        if found:
            want[b, k] = (min(found)[1], -min(found)[0])
    got = {(r.block, r.key): (r.other, r.score) for r in similar.best_of_others(sets(spark, new), sets(spark, old)).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want) and len(want) > 50


def test_restates(spark):
    rng = random.Random(3)
    n = 60
    rows = [(i, i // 4, rng.sample(range(6), rng.choice([0, 0, 1, 2])), [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    params = [(i, f"p{rng.randrange(5)}") for i in range(n) for _ in range(2)] + [(i, "everywhere") for i in range(n)]
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(30)]
    sig = {i: {s for k, s in params if k == i and s != "everywhere"} for i in range(n)}
    edges = {frozenset(x) for x in links}
    want = set()
    for a in rows:
        for b in rows:
            both = sig[a[0]] & sig[b[0]]
            near = set(a[2]) & set(b[2]) or ((not a[2] or not b[2]) and (a[1] == b[1] or frozenset((a[0], b[0])) in edges))
            dot = sum(x * y for x, y in zip(a[3], b[3])) / math.sqrt(sum(x * x for x in a[3]) * sum(x * x for x in b[3]))
            if a[0] != b[0] and both and near and dot >= 0.3:
                want.add((a[0], b[0], min(both)))
    c = spark.createDataFrame(rows, "clause_id long, doc_id long, sections array<long>, vec array<double>")
    got = similar.restates(c, spark.createDataFrame(params, "clause_id long, signature string"), spark.createDataFrame(links, "from_id long, to_id long"), 0.3, most=40)
    assert {(r.from_id, r.to_id, r.signature) for r in got.collect()} == want and len(want) > 20


def test_inclusions_and_clause_columns(spark):
    a = spark.createDataFrame([(i, f"{i}.{i % 3}", None) for i in range(20)], "a_key int, clause string, nothing int")
    b = spark.createDataFrame([(i % 10, 1, [1]) for i in range(50)], "a_key int, one int, list array<int>")
    got = {(r.child, r.parent): (r.n_values, r.n_matched, r.parent_unique, r.named) for r in inclusion.inclusions({"a": a, "b": b}).collect()}
    assert got == {("b.a_key", "a.a_key"): (10, 10, True, True), ("b.one", "a.a_key"): (1, 1, True, False)}
    assert [tuple(r) for r in inclusion.foreign_keys(inclusion.inclusions({"a": a, "b": b})).collect()] == [("b.a_key", "a.a_key", 1.0)]
    ids = a.select(F.lit("d").alias("doc_id"), F.col("clause").alias("local_id")).where("a_key < 17").unionByName(a.select(F.lit("e").alias("doc_id"), F.col("clause").alias("local_id")).where("a_key < 15"))
    assert [(r.col, r.doc_id, r.known) for r in inclusion.reference_columns("a", a, ids).collect()] == [("a.clause", "d", 0.85)]


def test_a_table_is_held_against_itself_once(spark, monkeypatch):
    rows, seen = texts(random.Random(4), 60), []
    real = similar.similar
    monkeypatch.setattr(similar, "similar", lambda left, right, least: seen.append(right) or real(left, right, least))
    one = sets(spark, rows)
    got = {(r.block, r.key): (r.other, r.score) for r in similar.best_of_others(one, one).collect()}
    want = {}
    for b, k, t in rows:
        found = [(-alike(t, u), j) for c, j, u in rows if c == b and j != k and alike(t, u) >= 0.8]
        if found:
            want[b, k] = (min(found)[1], -min(found)[0])
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want) and len(want) > 5
    assert seen == [None]


@pytest.mark.parametrize("crowd", [1, 3, 8])
def test_frequent_elements_lose_no_pair(spark, monkeypatch, crowd):
    """Elements of more than a few sets come last; sets that have little else are held against each other by exact counts."""
    rows, exact = texts(random.Random(5), 150), []
    real = similar.by_rarest
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "by_rarest", lambda *a: exact.append(a[0].count()) or real(*a))
    want = {(a[1], b[1]): alike(a[2], b[2]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and alike(a[2], b[2]) >= 0.8}
    assert {(r.a, r.b): r.score for r in similar.similar(sets(spark, rows)).collect()} == pytest.approx(want) and len(want) > 50
    two = {(r.a, r.b) for r in similar.similar(sets(spark, rows), sets(spark, rows)).collect()}
    assert two == {p for a, b in want for p in ((a, b), (b, a))} | {(r[1], r[1]) for r in rows} and len(exact) == 2


def test_elements_are_not_all_counted(spark, monkeypatch):
    """Of sets without frequent elements no more than a third of the elements are counted, and those alone are fetched whole that may be alike."""
    rows = [("a", i, " ".join(f"w{i}x{j}" for j in range(104))) for i in range(40)]
    rows += [("a", 100 + i, t + " more") for _, i, t in rows[:3]]
    seen = []
    real = similar.kept
    monkeypatch.setattr(similar, "kept", lambda df: seen.append(real(df)) or seen[-1])
    monkeypatch.setattr(similar, "prefixes", None)
    got = {(r.a, r.b) for r in similar.similar(sets(spark, rows)).collect()}
    assert got == {(i, 100 + i) for i in range(3)}
    assert [df.select(F.sum(F.size("look"))).first()[0] <= 0.33 * 43 * 100 for df in seen if "look" in df.columns] == [True]
    assert [df.count() for df in seen if "g" in df.columns] == [6]
