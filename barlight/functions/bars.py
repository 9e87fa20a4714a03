"""Column functions on bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def finite(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def garman_klass(o: Column, h: Column, low: Column, c: Column) -> Column:
    floor = lambda x: F.greatest(x, F.lit(1e-8))
    hl, co = F.log(floor(h) / floor(low)), F.log(floor(c) / floor(o))
    return F.greatest(0.5 * hl * hl - (2 * LN2 - 1) * co * co, F.lit(0.0))


def parkinson(h: Column, low: Column) -> Column:
    hl = F.log(F.greatest(h, F.lit(1e-8)) / F.greatest(low, F.lit(1e-8)))
    return hl * hl / (4 * LN2)


def volatility(mean_variance: Column) -> Column:
    return F.sqrt(F.greatest(mean_variance, F.lit(1e-10)))


def volume_ratio(volume: Column, mean: Column) -> Column:
    return volume / F.greatest(F.coalesce(F.when(~F.isnan(mean), mean), F.lit(1.0)), F.lit(1e-4))


def change(close: Column, before: Column) -> Column:
    return F.coalesce(F.try_divide(close, before) - 1, F.lit(0.0))


def decoupling(ratio: Column, ret: Column) -> Column:
    return ratio / (F.abs(ret) + 1e-3)


def robust_z(x: Column, median: Column, mad: Column, floor: float = 1e-4) -> Column:
    z = 0.6745 * (x - median) / F.greatest(mad, F.lit(floor))
    return F.when(finite(z), z).otherwise(0.0)
