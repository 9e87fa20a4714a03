"""Notes: front-matter documents as typed rows, categories as partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.functions import text as ft
from barlight.sources.scratch import scratch_path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every markdown file under path as one note."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return parse(files.withColumn("path", F.col("_metadata.file_path")))


def parse(files: DataFrame) -> DataFrame:
    """files: value (and path). Header fields with defaults and bounds, and the body."""
    head = F.regexp_extract("value", "(?s)^---\\n(.*?)\\n---\\n?", 1)
    body = F.when(head != "", F.regexp_replace("value", "(?s)^---\\n.*?\\n---\\n?", "")).otherwise(F.col("value"))
    lines = F.filter(F.split(head, "\n"), lambda s: s.contains(":"))
    fields = F.map_from_entries(F.transform(lines, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("k"), F.trim(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("v"))))
    got = lambda k: F.nullif(F.try_element_at("_f", F.lit(k)), F.lit(""))

    def listed(k: str) -> Column:
        inner = F.regexp_replace(F.coalesce(got(k), F.lit("")), "^\\[|\\]$", "")
        return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")

    unit = lambda k, default: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(got(k).try_cast("double"), F.lit(default))))
    out = files.select(*(["path"] if "path" in files.columns else []), fields.alias("_f"), body.alias("_body"))
    return out.select(
        *(["path"] if "path" in files.columns else []),
        got("id").alias("id"), F.coalesce(got("title"), got("name"), F.lit("untitled")).alias("title"), F.coalesce(got("description"), F.lit("")).alias("description"),
        F.coalesce(got("type"), F.lit("project")).alias("memory_type"), F.coalesce(got("category"), F.lit("")).alias("category"), F.coalesce(got("compression_level"), F.lit("raw")).alias("compression_level"),
        F.transform(F.slice(listed("keywords"), 1, 5), lambda k: F.left(k, F.lit(30))).alias("keywords"), F.filter(listed("related_memories"), lambda x: x.rlike("^[0-9a-f]{6}$")).alias("related_memories"),
        unit("quality_score", 0.5).alias("quality_score"), unit("importance", 0.5).alias("importance"), F.coalesce(got("access_count").try_cast("int"), F.lit(0)).alias("access_count"),
        F.try_to_timestamp(got("created_at")).alias("created_at"), F.try_to_timestamp(got("updated_at")).alias("updated_at"), ft.truncated(F.col("_body")).alias("body"),
    )


def by_category(notes: DataFrame, categories: list[str]) -> DataFrame:
    """Write notes in one folder a category; read these categories' folders alone."""
    path = scratch_path(notes.sparkSession, "notes")
    notes.write.partitionBy("category").parquet(path)
    return notes.sparkSession.read.parquet(path).where(F.col("category").isin(*categories))


def rollup(notes: DataFrame, categories: list[str], most: int = 10) -> DataFrame:
    """notes: category, keywords, place. category, n and its first distinct keywords in order of place, comma-joined."""
    dim = notes.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    counts = notes.groupBy("category").agg(F.count("*").alias("n"))
    words = notes.select("category", "place", F.posexplode("keywords").alias("at", "k")).withColumn("k", F.lower(F.trim("k"))).where("k <> ''")
    first = words.groupBy("category", "k").agg(F.min(F.struct("place", "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("first", "k"))
    kept = first.withColumn("_n", rank).where(F.col("_n") <= most).groupBy("category").agg(F.sort_array(F.collect_list(F.struct("_n", "k"))).alias("w"))
    out = F.broadcast(dim).join(counts, "category", "left").join(kept, "category", "left")
    return out.select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join(F.transform("w", lambda x: x["k"]), ","), F.lit("")).alias("keywords"))
