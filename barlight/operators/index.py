"""A full-text index as tables that live: segments of postings, tombstones, upserts, merges, and a search that reads only what it asks for.

    path/segment=N/postings/bucket=B   doc_id, dl, term, tf, level; a term is in one bucket of its hash
    path/segment=N/docs                doc_id, dl
    path/segment=N/gone                doc_id: versions in earlier segments no longer count
    path/segment=N/whole               only if the segment holds everything before it: earlier segments no longer count at all

A segment is written to its end or is not there: its `gone` is written last and makes it visible. So every writer adds one segment and none changes
another; after a crash the next one takes the next number. Writers have to take turns. Rows without id are left out; of several rows with one id in
an upsert all terms count, as of one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.operators import search as ranks
from barlight.sources.scratch import cleared, delete
from barlight.sources.scratch import materialise as written

BUCKETS = 64
POSTING = "doc_id long, dl long, term string, tf long, level int, bucket int"


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _listed(spark: SparkSession, path: str, glob: str) -> list[int]:
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/segment=*/{glob}/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getParent().getName().split("=")[1]) for f in found)


def segments(spark: SparkSession, path: str) -> list[int]:
    """Visible segments that count, in order."""
    seen, whole = _listed(spark, path, "gone"), set(_listed(spark, path, "whole"))
    first = max((n for n in seen if n in whole), default=0)
    return [n for n in seen if n >= first]


def _next(spark: SparkSession, path: str) -> int:
    every = [*_listed(spark, path, "gone"), *_listed(spark, path, "docs"), *_listed(spark, path, "postings"), *_listed(spark, path, "whole")]
    return max(every, default=0) + 1


def _write(spark: SparkSession, path: str, postings: DataFrame, docs: DataFrame, gone: DataFrame, whole: bool = False) -> int:
    n = _next(spark, path)
    at = f"{path}/segment={n}"
    postings.repartition("bucket").sortWithinPartitions("bucket", "term", F.desc("level")).write.partitionBy("bucket").parquet(f"{at}/postings")
    docs.write.parquet(f"{at}/docs")
    if whole:
        spark.range(0).write.parquet(f"{at}/whole")
    gone.write.parquet(f"{at}/gone")
    return n


def _entries(docs: DataFrame, tokens: Callable, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings and sizes: one tokenisation, written; only rows that share an id are gathered by it."""
    rows = written(ranks.forward(docs.where(F.col(doc_id).isNotNull()), tokens, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long")), "forward")
    repeated = written(rows.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated")
    whole = rows
    if not repeated.isEmpty():
        shared = rows.join(repeated, "doc_id", "left_semi")
        merged = shared.select("doc_id", F.explode("terms").alias("x")).groupBy("doc_id", F.col("x.term").alias("term")).agg(F.sum("x.tf").alias("tf"))
        sizes = shared.groupBy("doc_id").agg(F.sum("dl").alias("dl"))
        gathered = sizes.join(merged, "doc_id", "left").select("doc_id", "dl", F.when(F.col("term").isNull(), F.array().cast("array<struct<term:string,tf:long>>")).otherwise(F.array(F.struct("term", "tf"))).alias("terms"))
        whole = rows.join(repeated, "doc_id", "left_anti").unionByName(gathered)
    postings = ranks.postings_of(whole).withColumn("level", ranks.level())
    sizes = whole.select("doc_id", "dl") if whole is rows else whole.select("doc_id", "dl").distinct()
    return postings.select("doc_id", "dl", "term", "tf", "level", bucket(F.col("term")).alias("bucket")), sizes


def upsert(docs: DataFrame, path: str, tokens: Callable, doc_id: str = "doc_id", text: str = "text") -> int:
    """Adds documents, in place of those with their ids. The new segment's number."""
    spark = docs.sparkSession
    with cleared(spark):
        postings, sizes = _entries(docs, tokens, doc_id, text)
        return _write(spark, path, postings, sizes, sizes.select("doc_id"))


def remove(ids: DataFrame, path: str) -> int:
    """ids: doc_id. They are no longer found. The new segment's number."""
    spark = ids.sparkSession
    gone = ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return _write(spark, path, spark.createDataFrame([], POSTING), spark.createDataFrame([], "doc_id long, dl long"), gone)


def _gone(spark: SparkSession, path: str, own: list[int]) -> DataFrame:
    """doc_id, until: versions before this segment do not count."""
    parts = [spark.read.schema("doc_id long").parquet(f"{path}/segment={n}/gone").withColumn("until", F.lit(n)) for n in own]
    return _union(parts, "doc_id long, until int", spark).groupBy("doc_id").agg(F.max("until").alias("until"))


def _union(parts: list[DataFrame], schema: str, spark: SparkSession) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part)
    return out


def _live(spark: SparkSession, path: str, kind: str, schema: str, where: str = "true") -> DataFrame:
    """Rows of the segments that count, without those whose document came again or went later."""
    own = segments(spark, path)
    parts = [spark.read.schema(schema).parquet(f"{path}/segment={n}/{kind}").where(where).withColumn("segment", F.lit(n)) for n in own]
    rows = _union(parts, f"{schema}, segment int", spark)
    if len(own) < 2:
        return rows.drop("segment")
    met = rows.join(_gone(spark, path, own), "doc_id", "left")
    return met.where("until is null or until <= segment").drop("segment", "until")


def live_docs(spark: SparkSession, path: str) -> DataFrame:
    return _live(spark, path, "docs", "doc_id long, dl long")


def live_postings(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """Postings that count, of these buckets alone: the other folders are not read."""
    return _live(spark, path, "postings", POSTING, "true" if buckets is None else f"bucket in ({', '.join(map(str, buckets)) or 'null'})")


def populated(spark: SparkSession, path: str) -> bool:
    return bool(segments(spark, path)) and not live_docs(spark, path).isEmpty()


def merge(spark: SparkSession, path: str) -> int:
    """One segment in place of all; what no longer counts goes."""
    before = _listed(spark, path, "gone")
    n = _write(spark, path, live_postings(spark, path), live_docs(spark, path), spark.createDataFrame([], "doc_id long"), whole=True)
    for old in before:
        delete(spark, f"{path}/segment={old}")
    return n


def rebuild(docs: DataFrame, path: str, tokens: Callable, doc_id: str = "doc_id", text: str = "text") -> int:
    """The index of these documents and no others."""
    spark, before = docs.sparkSession, _listed(docs.sparkSession, path, "gone")
    with cleared(spark):
        postings, sizes = _entries(docs, tokens, doc_id, text)
        n = _write(spark, path, postings, sizes, sizes.select("doc_id"), whole=True)
    for old in before:
        delete(spark, f"{path}/segment={old}")
    return n


def search(path: str, queries: DataFrame, tokens: Callable, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """queries: query_id, query. The hits of operators.search.search over the documents that the index holds now, from the folders of the asked terms alone."""
    spark = queries.sparkSession
    with cleared(spark) as keep:
        asked = queries.select(F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).distinct()
        asked = written(asked.withColumn("bucket", bucket(F.col("term"))), "asked")
        buckets = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # at most BUCKETS
        posted = live_postings(spark, path, buckets).join(asked.select("term"), "term", "left_semi")
        rows = written(posted.select("doc_id", "dl", F.array(F.struct("term", "tf")).alias("terms")), "postings")
        total = live_docs(spark, path).agg(F.count("*").alias("docs"), F.avg("dl").alias("mean"))
        lists = written(ranks.lists_of(rows, total.select(F.col("mean").alias("top")), k1, b), "lists")
        found = ranks.best(ranks.asked_terms(queries, tokens, lists, total), rows, k, k1, b)
        return keep(written(found.withColumnRenamed("q", "query_id"), "hits"))


def search_chain(path: str, queries: DataFrame, docs: DataFrame, tokens: Callable, spare: Callable[[DataFrame], DataFrame], k: int = 5) -> DataFrame:
    """query_id, id, score, rank, via: hits of the index; if it holds nothing it is rebuilt, once, from docs; queries that still have none go to `spare`."""
    if not populated(queries.sparkSession, path):
        rebuild(docs, path, tokens)
    first = search(path, queries, tokens, k).withColumnRenamed("doc_id", "id")
    missed = queries.join(first.select("query_id").distinct(), "query_id", "left_anti")
    return ranks.with_fallback(first, spare(missed), queries)
