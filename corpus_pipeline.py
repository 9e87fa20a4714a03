"""Corpus pipeline: quality rules, near duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm import decision_list, decontaminate, jaccard_join, packing, secret_markov
from barlight.llm.queries import tokenizer_path
from barlight.llm.shared import row_key
from barlight.sources.scratch import cleared, delete, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned one rejects go."""
    return decision_list.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the one with the smallest id, rows without id last."""
    return jaccard_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, whole or edited, go."""
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text"), F.struct(*docs.columns).alias("row"))
    found = decontaminate.find(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="key")
    return keyed.select("key", "row").join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked out of the texts; n_chars follows."""
    found = secret_markov.scan(docs, secret_markov.train(docs), redact=True, carry=True)
    changed = {"text": F.col("redacted"), "n_chars": F.coalesce(F.length("redacted").cast("long"), F.col("row.n_chars"))}
    return found.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("packing", packed),
]

#: Learned rules, alignment and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with cleared(spark) as keep:
        for name, stage in STAGES:
            before = docs
            with cleared(spark) as keep_stage:
                docs = keep_stage(materialise(stage(spark, docs, sf_dir), f"corpus-{name}"))
            if before is not given:
                delete(spark, before.scratch_path_)
        return keep(docs)
