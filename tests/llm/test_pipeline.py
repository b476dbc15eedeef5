import corpus_pipeline
from tessera.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_drop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n, first = docs.columns, docs.count(), docs
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), first.schema)
        assert docs.columns == columns and docs.count() <= n and docs.select("doc_id").distinct().count() == docs.count()
        n = docs.count()
        for r in docs.collect():
            assert texts[r.doc_id] == r.text if k < 3 else len(r.text) <= len(texts[r.doc_id])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_queries_return_their_columns(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    want = {
        "op2_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op4_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op5_simhash": ["doc_id", "fingerprint", "component_id"],
        "op6_suffixes": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op7_ring": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op10_sketches": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    }
    for name, columns in want.items():
        df = Q.QUERIES[name](spark, SF)
        assert df.columns[: len(columns)] == columns and df.count() == n, name


def test_a_run_releases_only_its_own_tables(spark, monkeypatch):
    """Tables that other queries write meanwhile, in this thread or another, can still be read."""
    import threading

    from tessera.llm import common

    others = []

    def stage(spark, docs, sf_dir):
        other = threading.Thread(target=lambda: others.append(common.materialize(spark.range(7))))
        other.start()
        other.join()
        with common.own_tables():
            others.append(common.materialize(spark.range(5)))
        return common.materialize(docs.where("doc_id % 2 = 0"))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("last", lambda spark, docs, sf_dir: docs)])
    before = common.materialize(spark.range(3))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and before.count() == 3 and sorted(x.count() for x in others) == [5, 5, 7, 7]


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, one doc_id with two texts, and further columns whose names operators use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "kept", 5, "p") for r in docs]
    rows += rows[:5]
    rows += [(None, rows[7][1], None, None, None, None, None, None), (None, None, "en", "s", 0, "kept", 5, "p"), (9001, "", "en", "s", 0, "kept", 5, "p"), (9002, None, "en", "s", 0, "kept", 5, "p"), (9003, "word " * 60_000, "en", "s", 1, "kept", 5, "p"), (9004, "x" * 50_000, "en", "s", 1, "kept", 5, "p"), (rows[3][0], rows[20][1], "en", "s", 1, "other", 6, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tag string, part int, kept string")


def test_every_stage_takes_odd_rows(spark):
    docs = odd_documents(spark)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert len(got) <= n, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        given = {(r.doc_id, r.lang, r.source, r.n_chars, r.tag, r.part, r.kept) for r in docs.collect()}
        assert {(r.doc_id, r.lang, r.source, r.n_chars, r.tag, r.part, r.kept) for r in got} <= given, name
        if name == "substring dedup":
            assert len(got) == n
        if name == "simhash near-dedup":  # copies of one text are one, unless nothing tells that they belong together
            assert len({r.text for r in got if r.doc_id is not None and r.text}) == sum(1 for r in got if r.doc_id is not None and r.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    ids = [r.doc_id for r in packed.where("piece = 0").collect()]
    assert len(ids) == n and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    fill = {}
    for r in packed.collect():
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_quality_stage_equals_the_operator_judged_row_by_row(spark):
    """The stage keeps what a plain reading of its rules and of the model's ratio keeps."""
    docs = odd_documents(spark)
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF).select("doc_id", "text").collect()
    words = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
    for r in kept:
        w = words(r.text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 5000 else set()
        held = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
        assert len(w) >= 10 and 100 * len(held) <= 20 * len(w)
