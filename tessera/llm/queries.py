"""Queries of the training-data operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, centroids, codes, exact, fuzzy, licenses, maintext, oracles, packing, quality, sharding, simhash, sketches, toxicity
from tessera.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_digests(documents(spark, sf_dir))


def op7_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), 40)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.passages(documents(spark, sf_dir))


def op10_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_versions(documents(spark, sf_dir))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_licenses, op2_quality, op3_toxicity, op4_bpe, op5_simhash, op6_suffixes, op7_ring, op8_packing, op9_chains, op10_sketches, op11_main_text, op12_centroids, op13_codes)}
#: Places that start a string of 50 bytes which a smaller document has, islands of them, and what lies between the islands.
SQL: dict[str, str] = {
    "op6_suffixes": """with d as (select doc_id, encode(coalesce(text, '')) as b from documents), n as (select doc_id, b, octet_length(b) as n from d),
w as (select doc_id, i, b[i:i + 49] as s from (select doc_id, b, unnest(generate_series(1, n - 49)) as i from n where n >= 50)),
f as (select s, min(doc_id) as m from w group by s), c as (select doc_id, i from w join f using (s) where m < doc_id),
g as (select doc_id, i, sum(k) over (partition by doc_id order by i) as k from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as k from c)),
r as (select doc_id, k, min(i) as a, max(i) + 49 as z from g group by doc_id, k),
e as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 as p from r),
q as (select doc_id, p, a - 1 as q from e union all select doc_id, coalesce(z, 0) + 1, n from n left join (select doc_id, max(z) as z from r group by doc_id) using (doc_id)),
h as (select q.doc_id, string_agg(case when q.q >= q.p then hex(n.b[q.p:q.q]) else '' end, '' order by q.p) as x from q join n using (doc_id) group by q.doc_id),
t as (select doc_id, sum(z - a + 1) as n_removed, count(*) as n_spans from r group by doc_id)
select n.doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(x)) as kept_sha256 from n join h using (doc_id) left join t using (doc_id)""",
    "op12_centroids": oracles.clusters(),
    "op13_codes": oracles.codes(),
}
