"""Non-maximum suppression and diversified top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prune_limit(keep: int, gap: int) -> int:
    """Candidates of a group that can matter: each of keep - 1 kept ones rejects at most 2 (gap - 1) others."""
    return (keep - 1) * 2 * (gap - 1) + keep


def suppress(candidates: DataFrame, keys: list[str], strength: str = "strength", pos: str = "pos", keep: int = 10, gap: int = 60) -> DataFrame:
    """Of each group, by falling strength (ties: larger pos first), rows no kept one is closer to than gap; at most keep."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(strength), F.desc(pos)))
    near = candidates.withColumn("_rank", rank).where(F.col("_rank") <= prune_limit(keep, gap))
    rest = [c for c in candidates.columns if c not in keys]
    rows = near.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_rank", *rest))).alias("_all"))
    places = F.aggregate(
        "_all", F.array().cast("array<long>"),
        lambda kept, x: F.when((F.size(kept) < keep) & ~F.exists(kept, lambda p: F.abs(p - x[pos]) < gap), F.array_append(kept, x[pos].cast("long"))).otherwise(kept),
    )
    kept = rows.withColumn("_kept", places).withColumn("_x", F.explode(F.filter("_all", lambda x: F.array_contains(F.col("_kept"), x[pos].cast("long")))))
    return kept.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def top(signals: DataFrame, per_symbol: int = 10, total: int = 50) -> DataFrame:
    """The strongest signals, at most per_symbol of a symbol; ties keep scanner, then symbol, then id order."""
    order = [F.desc(F.abs("effect_size")), F.col("scanner"), F.col("symbol"), F.col("pos")]
    first = signals.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(*order))).where(F.col("_n") <= per_symbol)
    return first.drop("_n").orderBy(*order).limit(total)
