"""Rules that depend on the order of a key's rows, in constant memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

BATCH = 4096  # rows given out at once


def folded(rows: DataFrame, keys: list[str], order: list[str], rule: Callable[[Iterator[dict]], Iterator[dict]], schema: str, size: str | None = None) -> DataFrame:
    """rule over each key's rows in order, nulls first; what it yields has this schema (names and types). size names a column to add before: the key's rows.

    Spark sorts the rows of a task, on disk where need be; the rule sees them one by one, so no key's rows are gathered. One key is one task.
    A rule has to read its rows to the end or may stop before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in batches for row in b.to_pylist())
        out = []
        for _, group in groupby(each, key=lambda row: tuple(row[k] for k in keys)):
            for made in rule(group):
                out.append(made)
                if len(out) == BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    dealt = rows.repartition(*keys)
    if size:
        dealt = dealt.withColumn(size, F.count("*").over(Window.partitionBy(*keys)))
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
