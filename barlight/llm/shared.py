"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.sources.scratch import materialise


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back."""
    return materialise(df, f"barlight-{name}")


def bind(value: Column, body) -> Column:
    """body(x) with x evaluated once for a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of a row's own by its id and text, also without either; only repeats of a row share it."""
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
