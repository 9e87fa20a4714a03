"""JSON-line logs: tolerant reading, side files for long fields, tails, artifact checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All lines under path that are JSON of this schema; blank and broken lines are left out."""
    return parse_lines(spark.read.text(path, recursiveFileLookup=True), schema)


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    parsed = lines.where("trim(value) <> ''").select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def restore(rows: DataFrame, field: str, blobs: DataFrame) -> DataFrame:
    """Fill a field from the side table (path, text) where only its path is there; paths that leave the root are ignored."""
    path = F.col(f"{field}_path")
    safe = F.when(path.rlike("^[A-Za-z0-9_][A-Za-z0-9_./-]*$") & ~path.rlike("(^|/)\\.\\.(/|$)"), path)
    found = rows.withColumn("_path", safe).join(blobs.select(F.col("path").alias("_path"), F.col("text").alias("_text")), "_path", "left")
    return found.withColumn(field, F.coalesce(field, "_text")).drop("_path", "_text", f"{field}_path")


def offload(rows: DataFrame, field: str, longest: int = 50_000, preview: int = 500) -> tuple[DataFrame, DataFrame]:
    """rows with long fields replaced by path, preview and size; and the side table (path, text) of those fields."""
    text = F.col(field)
    long = F.length(text) > longest
    path = F.concat(F.lit("blobs/"), F.substring(F.sha2(F.concat(F.lit(field), F.lit("\0"), text), 256), 1, 24))
    marked = rows.withColumns({f"{field}_path": F.when(long, path), f"{field}_preview": F.when(long, F.substring(text, 1, preview)), f"{field}_size": F.when(long, F.length(text))})
    blobs = marked.where(F.col(f"{field}_path").isNotNull()).groupBy(F.col(f"{field}_path").alias("path")).agg(F.first(text).alias("text"))
    return marked.withColumn(field, F.when(~F.coalesce(long, F.lit(False)), text)), blobs


def tail(rows: DataFrame, key: str, line: str, offset: int) -> DataFrame:
    """Lines of each log beyond the first `offset`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(line))).where(F.col("_n") > offset).drop("_n")


def verified(rows: DataFrame, claimed: Column, content: Column, run_id: Column | None = None, runs: DataFrame | None = None) -> DataFrame:
    """verified: the claimed hash, with or without `sha256:` before it, is that of the content, or the run named is among runs (run_id)."""
    hash_ = F.regexp_replace(F.lower(F.trim(claimed)), "^sha256:", "")
    same = F.coalesce(hash_ == F.sha2(content, 256), F.lit(False))
    if runs is None:
        return rows.withColumn("verified", same)
    known = runs.select(F.col("run_id").alias("_run")).distinct().withColumn("_known", F.lit(True))
    joined = rows.withColumn("_run", run_id).join(known, "_run", "left")
    return joined.withColumn("verified", same | F.coalesce("_known", F.lit(False))).drop("_run", "_known")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of each file's bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))
