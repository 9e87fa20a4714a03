"""Robust baselines: median and median absolute deviation by symbol, and z-scores against them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions import bars as fb
from barlight.sources.scratch import cleared, materialise


def cell(x: Column, per_octave: int = 256) -> Column:
    """A coarse number that grows with x: the place of its logarithm, mirrored for negative values; null for null."""
    place = F.floor(F.log2(F.abs(x)) * per_octave) + 1100 * per_octave  # the smallest double is 2^-1074
    return F.when(x > 0, place).when(x < 0, -place).when(x == 0, F.lit(0)).cast("int")


def _at(x: np.ndarray, k: np.ndarray, rank: int) -> float:
    """The value of this rank among x, each k times."""
    order = np.argsort(x, kind="stable")
    return x[order][np.searchsorted(np.cumsum(k[order]), rank, "right")]


def _needed(table: pa.Table) -> pa.Table:
    """Cells of a symbol's column that can decide its median and deviation, after a row with its counts."""
    known = table.filter(table.column("cell").is_valid()).sort_by("cell")
    cell, k, low, high = (known.column(c).to_numpy() for c in ("cell", "k", "low", "high"))
    n, n_rows = int(k.sum()), int(table.column("k").to_numpy().sum())
    kept, centre, ring, before, under = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool), 0, 0
    if n:
        upto = np.cumsum(k)
        first, last = np.searchsorted(upto, [(n - 1) // 2, n // 2], "right")
        least, most, before = low[first], high[last], int(upto[first] - k[first])
        # Deviations of a cell's values from any median between these lie between d_low and d_high.
        d_low, d_high = np.maximum(np.maximum(low - most, least - high), 0.0), np.maximum(high - least, most - low)
        nearest, farthest = _at(d_low, k, (n - 1) // 2), _at(d_high, k, n // 2)
        under, ring = int(k[d_high < nearest].sum()), (d_high >= nearest) & (d_low <= farthest)
        centre = np.zeros(len(k), bool)
        centre[first : last + 1] = True
        kept = np.flatnonzero(centre | ring)
    size, key = 1 + len(kept), table.slice(0, 1)
    columns = {
        "symbol": key.column("symbol").take(pa.array(np.zeros(size, int))), "c": key.column("c").take(pa.array(np.zeros(size, int))), "cell": pa.array([None, *cell[kept].tolist()], pa.int32()),
        "n_rows": np.full(size, n_rows), "n": np.full(size, n), "centre": [False, *centre[kept].tolist()], "ring": [False, *ring[kept].tolist()], "before": np.full(size, before), "under": np.full(size, under),
    }
    return pa.table(columns)


def cells(values: DataFrame) -> DataFrame:
    """values: symbol, c, x (null where not valid). One aggregate over all values into cells, some thousands for a column, whatever the rows; of these the few that matter.

    n: valid values (n_rows: all); centre: the cell may hold a middle rank; before: how many values come before those; ring: it may hold a middle rank of the
    deviations from the median, wherever in the centre cells that is; under: how many values surely deviate less than all of the ring. Of each column one row has no cell.
    """
    counts = values.withColumn("cell", cell(F.col("x"))).groupBy("symbol", "c", "cell").agg(F.count("*").alias("k"), F.min("x").alias("low"), F.max("x").alias("high"))
    kind = values.schema["symbol"].dataType.simpleString()
    return counts.groupBy("symbol", "c").applyInArrow(_needed, f"symbol {kind}, c int, cell int, n_rows long, n long, centre boolean, ring boolean, before long, under long")


def exact_baselines(values: DataFrame) -> DataFrame:
    """symbol, c, n_rows, n, median, mad from two passes over the values: counts of cells, then the distinct values of the few cells that can matter.

    The tables in between are small enough to be broadcast where the planner, who knows their sizes, finds them so; a task sorts the values of
    such cells of a column, about a hundredth of all.
    """
    own = materialise(cells(values), "cells")
    near = values.withColumn("cell", cell(F.col("x"))).join(own.where("cell is not null"), ["symbol", "c", "cell"])
    near = near.groupBy("symbol", "c", "x").agg(F.count("*").alias("k"), *[F.any_value(c).alias(c) for c in ("n", "centre", "ring", "before", "under")])
    by_column = Window.partitionBy("symbol", "c")

    def middle(order: str, counted: str, skipped: str) -> Column:
        """The mean of the two middle values in this order, of those that are counted; `skipped` others come before them."""
        k = F.when(F.col(counted), F.col("k")).otherwise(0)
        upto = F.col(skipped) + F.sum(k).over(by_column.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return F.when(F.col(counted) & (F.expr("n div 2") >= upto - k) & (F.expr("(n - 1) div 2") < upto), F.col(order))

    mean = lambda c: (F.min(c).over(by_column) + F.max(c).over(by_column)) / 2
    x = near.withColumn("_x", middle("x", "centre", "before")).withColumn("median", mean("_x")).withColumn("d", F.abs(F.col("x") - F.col("median")))
    x = x.withColumn("_d", middle("d", "ring", "under"))
    found = x.groupBy("symbol", "c").agg(F.max("median").alias("median"), ((F.min("_d") + F.max("_d")) / 2).alias("mad"))
    return own.where("cell is null").select("symbol", "c", "n_rows", "n").join(found, ["symbol", "c"], "left")


SKETCH_K = 8192  # the sketch keeps all values up to about so many; beyond, ranks are off by about 2 in 10,000


RANKS = np.arange(1, 1025) / 1024


def of_sketch(sketch: Column) -> tuple[Column, Column]:
    """Median and median absolute deviation of a quantile sketch's values, the latter over its 1,024 values of even ranks (the one in the middle of their deviations)."""
    known = F.kll_sketch_get_n_double(sketch) > 0
    values = F.kll_sketch_get_quantile_double(sketch, F.lit(RANKS))
    median = F.kll_sketch_get_quantile_double(sketch, F.lit(0.5))
    away = F.array_sort(F.transform(values, lambda x: F.abs(x - median)))
    return F.when(known, median), F.when(known, F.element_at(away, len(RANKS) // 2))


def sketched_baselines(values: DataFrame) -> DataFrame:
    """The same from one pass that leaves a mergeable sketch a column: about, not exactly, the middle ranks."""
    sizes = values.groupBy("symbol", "c").agg(F.count("*").alias("n_rows"), F.count("x").alias("n"), F.kll_sketch_agg_double("x", F.lit(SKETCH_K)).alias("sketch"))
    median, mad = of_sketch(F.col("sketch"))
    return sizes.select("symbol", "c", "n_rows", "n", median.alias("median"), mad.alias("mad"))


def baselines(rows: DataFrame, columns: dict[str, Column], exact: bool = True) -> DataFrame:
    """By symbol: med_<c>, mad_<c> and valid_<c> (their count) of the valid values of each column, and n_rows; columns maps a name to what makes it valid.

    Rows that are no stored table are stored once, the columns that are needed alone."""
    names = list(columns)
    with cleared(rows.sparkSession) as keep:
        valid = rows.select("symbol", *[F.when(ok, F.col(c)).alias(c) for c, ok in columns.items()])
        table = valid if hasattr(rows, "scratch_path_") else materialise(valid, "valid")
        values = table.select("symbol", F.posexplode(F.array(*names)).alias("c", "x"))
        of = lambda what, i: F.max(F.when(F.col("c") == i, F.col(what)))
        found = (exact_baselines if exact else sketched_baselines)(values)
        wide = found.groupBy("symbol").agg(
            *[of("n", i).alias(f"valid_{c}") for i, c in enumerate(names)], F.max("n_rows").alias("n_rows"), *[of(what, i).alias(f"{short}_{c}") for what, short in (("median", "med"), ("mad", "mad")) for i, c in enumerate(names)])
        return keep(materialise(wide, "baselines"))


def scored(rows: DataFrame, columns: dict[str, Column], exact: bool = True) -> DataFrame:
    """rows with z_<c> for each column and the baselines of their symbol."""
    return against(rows, baselines(rows, columns, exact), list(columns))


def against(rows: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """rows with z_<c> for each column and the baselines found of their symbol."""
    out = rows.join(found, "symbol")
    return out.withColumns({f"z_{c}": fb.robust_z(F.col(c), F.col(f"med_{c}"), F.col(f"mad_{c}")) for c in columns})
