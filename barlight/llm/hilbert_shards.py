"""Hilbert-curve shards: rows ordered along a curve through several metadata dimensions, cut into equal runs.

Each dimension is quantised by its own quantiles (texts by their whole values), the cell of a row gives its index on the curve (a table made by rule
once, 2^(dimensions*bits) numbers), and the order is (index, hash of id, text checksum and a number of the row's own). Ranks come from counts of
small buckets (cell, as many leading bits of the hash as the cell's rows ask for), so a cell that holds a third of all rows is many buckets, also if these
have one id or none, and no task sorts more than one bucket. What the order needs is written once, so the number is the same wherever it is read. The law kept is `rows`: a shard's row count differs from another's by one at most.

Defined cases: null text has no bytes, so size 1; null metadata are in the first cell, with the smallest values; rows that are equal in every part of
the order are interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.llm.shared import written
from barlight.sources.scratch import cleared


def curve(dims: int, bits: int) -> list[int]:
    """Index on the Hilbert curve of each cell, the cell numbered by its coordinates one after another (first highest).

    Walks the curve: cell k of it has Gray-coded digits, turned by the rotation and reflection that the digits before it left.
    """
    side, mask = 1 << bits, (1 << dims) - 1
    turn = lambda x, r: ((x << r) | (x >> (dims - r))) & mask if r % dims else x
    out = [0] * side**dims
    for k in range(side**dims):
        entry, axis, point = 0, 0, [0] * dims
        for level in reversed(range(bits)):
            digit = (k >> (dims * level)) & mask
            corner = turn(digit ^ (digit >> 1), (axis + 1) % dims) ^ entry
            for d in range(dims):
                point[d] |= ((corner >> d) & 1) << level
            first = 0 if digit == 0 else ((digit - 1) & ~1)
            entry ^= turn(first ^ (first >> 1), (axis + 1) % dims)
            ones = digit if digit & 1 else digit - 1
            axis = (axis + (0 if digit == 0 else ((~ones & (ones + 1)).bit_length() - 1) % dims) + 1) % dims
        out[reduce(lambda code, x: (code << bits) | x, point, 0)] = k
    return out


def text_bounds(docs: DataFrame, column: str, cells: int) -> list[str]:
    """The texts at the inner quantiles of a column: exact, from the counts of its distinct values in ranges of values."""
    counts = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))
    with cleared(docs.sparkSession):
        return _text_bounds(counts, cells)


def _text_bounds(counts: DataFrame, cells: int) -> list[str]:
    ranges = written(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "values")
    parts = ranges.groupBy("part").agg(F.sum("n").alias("k"))  # a row a shuffle partition
    before = parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy(F.lit(0))).alias("total"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    ranked = ranges.join(F.broadcast(before), "part").withColumn("upto", upto)
    found = ranked.agg(*[F.min(F.when(F.col("upto") * cells >= F.col("total") * i, F.col("x"))).alias(f"b{i}") for i in range(1, cells)]).first()
    return sorted({x for x in found if x is not None}, key=lambda x: x.encode())


def number_bounds(docs: DataFrame, columns: list[str], cells: int) -> dict[str, list[float]]:
    """The values at the inner quantiles of these columns, by mergeable sketches."""
    if not columns:
        return {}
    shares = [i / cells for i in range(1, cells)]
    found = docs.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return {c: sorted(set(found[i] or [])) for i, c in enumerate(columns)}


def place(docs: DataFrame, dims: list[str], bits: int = 4, bucket_rows: int = 1 << 18, doc_id: str = "doc_id", text: str = "text", n_shards: int = 16, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard, slot; carry adds row, all of docs."""
    kinds = dict(docs.dtypes)
    cells = 1 << bits
    bounds = number_bounds(docs, [d for d in dims if kinds[d] != "string"], cells) | {d: text_bounds(docs, d, cells) for d in dims if kinds[d] == "string"}
    value = lambda d: F.col(d) if kinds[d] == "string" else F.col(d).cast("double")
    above = lambda d: reduce(lambda a, b: a + b, [F.coalesce((value(d) > F.lit(b)).cast("int"), F.lit(0)) for b in bounds[d]], F.lit(0))
    cell = reduce(lambda a, b: F.shiftleft(a, bits).bitwiseOR(b), [above(d) for d in dims], F.lit(0))
    on_curve = F.element_at(F.lit(curve(len(dims), bits)), cell + 1).alias("hilbert")
    checksum = F.crc32(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))).alias("text_crc32")
    turn = F.xxhash64(F.col(doc_id).cast("string"), checksum, F.monotonically_increasing_id()).alias("turn")
    rows = written(docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").__add__(1).alias("size"), checksum, on_curve, turn, *[F.struct(*docs.columns).alias("row")] * carry), "order")
    counts = rows.groupBy("hilbert").agg(F.count("*").alias("k"))
    split = F.greatest(F.lit(3), F.ceil(F.log2(F.col("k") / bucket_rows))).cast("int").alias("split")
    splits = F.broadcast(written(counts.select("hilbert", split), "cells"))  # 2^(dimensions*bits) rows at most
    part = F.call_function("shiftrightunsigned", "turn", 64 - F.col("split")).alias("part")
    order = rows.join(splits, "hilbert").select(*rows.columns, part)
    # At most 8 * 2^(dimensions*bits) + 2 * rows / bucket_rows buckets.
    buckets = order.groupBy("hilbert", "part").agg(F.count("*").alias("n"))
    starts = buckets.select("hilbert", "part", (F.sum("n").over(Window.orderBy("hilbert", "part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    in_bucket = Window.partitionBy("hilbert", "part").orderBy("turn", "doc_id", "text_crc32", "size")  # turns that clash go by the rest
    ranked = order.withColumn("rank", F.row_number().over(in_bucket)).join(F.broadcast(starts), ["hilbert", "part"])
    rank = F.col("before") + F.col("rank") - 1
    shard = F.expr(f"(before + rank - 1) * {n_shards} div total")
    first = F.expr("(shard * total + {0} - 1) div {0}".format(n_shards))
    own = ["doc_id", "size", "text_crc32", "hilbert", *["row"] * carry]
    return (
        ranked.select(*own, "total", rank.alias("r"), shard.alias("shard"))
        .select(*own, F.col("shard").cast("int").alias("shard"), (F.col("r") - first).alias("slot"))
    )


def write(docs: DataFrame, dims: list[str], path: str, **placing) -> None:
    """Write docs, placed by these dimensions, as one folder of Parquet for each shard, rows in curve order. Every row once: repeated ids and rows without id are as good as others.

    The rows travel with their places, so no key has to find them again; they are written to the shared folder and shuffled once."""
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("docs has a column named shard or slot")
    placed = place(docs, dims, carry=True, **placing).select("row.*", "shard", "slot")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
