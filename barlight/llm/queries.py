"""Queries of this folder's operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm import (
    centroid_clusters, decision_list, decontaminate, filter_audit, hilbert_shards, jaccard_join, license_rules, packing, piece_codec, quality_crf, secret_markov, token_counts, url_filter,
)
from barlight.llm.shared import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_crf.score(docs, quality_crf.train(docs, labels))
    held_out = ~quality_crf.is_training(F.col("doc_id"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical addresses of the pages whose id is divisible by 50."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = pages.where(F.col("page_id") % 50 == 0).select(url_filter.canonical(url_filter.host(F.col("url")), url_filter.path(F.col("url"))).alias("key"))
    return url_filter.judge(pages, listed)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards.place(documents(spark, sf_dir), ["source", "lang", "n_chars"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secret_markov.scan(docs, secret_markov.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.digest(centroid_clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    own = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = piece_codec.decode(piece_codec.encode(documents(spark, sf_dir), *own), *own)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_licenses, op3_decontaminate, op4_url_filter, op5_token_counts, op6_quality_rules, op7_jaccard_join, op8_hilbert_shards, op9_secrets, op10_packing, op11_centroid_clusters, op12_filter_audit, op13_piece_codec)}

URL_FILTER_SQL = r"""
WITH given AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
keyed AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(\.html|/)$', '') END AS key FROM given),
rules(rule, domain, start, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
best AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM keyed, rules
  WHERE (host = domain OR host LIKE '%.' || domain) AND starts_with(path, start) GROUP BY page_id),
listed AS (SELECT DISTINCT key FROM keyed WHERE page_id % 50 = 0 AND key IS NOT NULL)
SELECT k.page_id, k.host, k.path, b.rule, coalesce(b.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.key IS NOT NULL AS listed
FROM keyed k LEFT JOIN best b USING (page_id) LEFT JOIN listed l ON k.key = l.key
"""

ORACLE_SQL = {"op2_licenses": license_rules.oracle(), "op4_url_filter": URL_FILTER_SQL, "op11_centroid_clusters": centroid_clusters.oracle(), "op12_filter_audit": filter_audit.ORACLE}
