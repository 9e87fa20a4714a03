"""Sidecar documents root/<symbol>/_metadata.json as a data source of its own, read and written by tasks.

Spark's file readers pass over names that start with an underscore. Here the folders of root are listed once, in groups of folders the tasks open their
sidecars; a condition on the symbol keeps the folders that it names. Writing puts one document for each row into the row's folder; the last row of a symbol stays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

FORMAT = "bar_sidecars"
NAME = "_metadata.json"
FIELDS = {"san": "venue", "symbol": "symbol", "schema_version": "schema_version", "nen": "compression", "nguon": "source", "tao_luc": "created_at"}  # fixed values: names in the documents, and ours
SCHEMA = ", ".join(f"{name} string" for name in ("folder", *FIELDS.values()))
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(root: str):
    """The file system of root and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root)


@dataclass
class Folders(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    """folder is pushed down as long as it is compared for equality; other conditions stay with Spark."""

    def __init__(self, root: str, per_task: int):
        self.root, self.per_task, self.asked = root.rstrip("/"), per_task, None

    def partitions(self) -> list[Folders]:
        from pyarrow import fs

        where, path = opened(self.root)
        folders = sorted(i.base_name for i in where.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.Directory)
        names = folders if self.asked is None else [f for f in folders if f in self.asked]
        return [Folders(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        where, path = opened(self.root)
        for name in partition.names:
            try:
                with where.open_input_stream(f"{path}/{name}/{NAME}") as f:
                    document = json.loads(f.read().decode("utf-8", "replace"))
            except (FileNotFoundError, json.JSONDecodeError):
                continue  # a folder without sidecar, or one that is no document
            if isinstance(document, dict):
                yield (name, *[None if document.get(k) is None else str(document[k]) for k in FIELDS])


class Pruned(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("folder",):
                now = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.asked = now if self.asked is None else self.asked & now
            else:
                yield f


class Writer(DataSourceWriter):
    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns = root.rstrip("/"), columns

    def write(self, rows: Iterator) -> WriterCommitMessage:
        where, path = opened(self.root)
        for row in rows:
            known = dict(zip(self.columns, row))
            if known.get("symbol"):
                where.create_dir(f"{path}/{known['symbol']}", recursive=True)
                with where.open_output_stream(f"{path}/{known['symbol']}/{NAME}") as f:
                    f.write(json.dumps({k: known.get(name) for k, name in FIELDS.items()}, ensure_ascii=False).encode())
        return WriterCommitMessage()


class Sidecars(DataSource):
    """Options: path, per_task (folders a task, 256)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = Pruned if self.options.get("pushdown") == "true" else Reader
        return kind(self.options["path"], int(self.options.get("per_task", 256)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], schema.names)


def read(spark: SparkSession, root: str, per_task: int = 256) -> DataFrame:
    """folder, venue, symbol, schema_version, compression, source, created_at (text). Conditions on folder reach the listing where the session pushes them down."""
    spark.dataSource.register(Sidecars)
    return spark.read.format(FORMAT).option("pushdown", str(spark.conf.get(PUSHDOWN, "false")).lower()).option("per_task", per_task).load(root)


def write(df: DataFrame, root: str) -> None:
    """df: symbol and any of venue, schema_version, compression, source, created_at; one document a symbol, made again without harm if a task is repeated."""
    df.sparkSession.dataSource.register(Sidecars)
    known = [F.col(c).cast("string").alias(c) for c in FIELDS.values() if c in df.columns]
    df.select(*known).where("symbol is not null and symbol <> ''").repartition("symbol").write.format(FORMAT).mode("append").save(root)


def stamped(bars: DataFrame, sidecars: DataFrame) -> DataFrame:
    """bars with venue and schema_version of their symbol's folder; null where there is no sidecar. The planner chooses the join by the sidecars' size."""
    few = sidecars.groupBy(F.col("folder").alias("symbol")).agg(F.first("venue").alias("venue"), F.first("schema_version").alias("schema_version"))
    return bars.join(few, "symbol", "left")
