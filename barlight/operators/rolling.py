"""Rolling features over bars, by buckets of rows with a halo so that one symbol is many tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions import bars as fb
from barlight.operators import moments


def with_halo(placed: DataFrame, halo: int, rows: int = 1 << 16) -> DataFrame:
    """Each row in its bucket of `rows` positions, and the last `halo` rows of a bucket once more in the next (own false)."""
    rows = max(rows, halo)
    bucket = F.expr(f"pos div {rows}")
    both = F.when((F.col("pos") % rows >= rows - halo) & (F.expr(f"(pos div {rows} + 1) * {rows}") < F.col("n")), F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    return placed.withColumn("bucket", F.explode(both)).withColumn("own", F.col("bucket") == bucket)


def by_bucket() -> Window:
    return Window.partitionBy("symbol", "bucket").orderBy("pos")


def _column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values, not a number where there is none, and where that is."""
    c = table.column(name)
    return c.to_numpy(), c.is_null().to_numpy()


def _before(x: np.ndarray, k: int, fill) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), fill, x.dtype), x[: max(len(x) - k, 0)]])


def _mean(x: np.ndarray, missing: np.ndarray, short: int) -> np.ndarray:
    """Mean of the values that there are among the last `short`; not a number if one of them is not finite, or if there is none."""
    odd = ~missing & ~np.isfinite(x)
    n, total = moments.sums((~missing).astype(np.int64), short), moments.sums(np.where(missing | odd, 0.0, x), short)
    return np.where((moments.sums(odd.astype(np.int64), short) > 0) | (n == 0), np.nan, total / np.maximum(n, 1))


def _features(table: pa.Table, long: int, short: int) -> pa.Table:
    """The columns of features() for one bucket's rows, the halo's left out."""
    table = table.take(pa.array(np.argsort(table.column("pos").to_numpy(), kind="stable")))
    own = table.column("own").to_numpy()
    (o, _), (h, _), (low, _), (c, c_missing), (v, v_missing) = (_column(table, x) for x in ("open", "high", "low", "close", "volume"))
    floor = lambda x, name: np.where(table.column(name).is_null().to_numpy(), 1e-8, np.maximum(x, 1e-8))
    with np.errstate(all="ignore"):
        no_log = c_missing | (c <= 0)
        logs = np.log(np.where(no_log, np.nan, c))
        ret = logs - _before(logs, 1, np.nan)
        no_ret = no_log | _before(no_log, 1, True)
        earlier = _before(c, short, np.nan)
        no_change = c_missing | _before(c_missing, short, True) | (earlier == 0)
        ret_short = np.where(no_change, 0.0, c / earlier - 1)

        skew, kurt, shaped = np.zeros(len(c)), np.zeros(len(c)), np.zeros(len(c), bool)
        if len(c) >= long:
            ok = ~no_ret & np.isfinite(ret)
            whole = moments.sums(ok.astype(np.int64), long)[long - 1 :] == long
            skew[long - 1 :], kurt[long - 1 :], varies = moments.shape(moments.windows(np.where(ok, ret, 0.0), long))
            shaped[long - 1 :] = whole & varies

        hl, co = np.log(floor(h, "high") / floor(low, "low")), np.log(floor(c, "close") / floor(o, "open"))
        gk = _mean(np.maximum(0.5 * hl * hl - (2 * fb.LN2 - 1) * co * co, 0.0), np.zeros(len(c), bool), short)
        pk = _mean(hl * hl / (4 * fb.LN2), np.zeros(len(c), bool), short)
        volume = _mean(v, v_missing, short)
        ratio = v / np.maximum(np.where(np.isnan(volume), 1.0, volume), 1e-4)
        made = {
            "ret": (ret, no_ret), "skew": (skew, ~shaped), "kurt": (kurt, ~shaped), "gk_vol": (np.sqrt(np.maximum(gk, 1e-10)), None), "pk_vol": (np.sqrt(np.maximum(pk, 1e-10)), None),
            "volume_ratio": (ratio, v_missing), "ret_short": (ret_short, None), "decoupling": (ratio / (np.abs(ret_short) + 1e-3), v_missing),
        }
    kept = table.select(["symbol", "event_time_ns", "pos", "n"]).filter(pa.array(own))
    for name, (x, missing) in made.items():
        kept = kept.append_column(name, pa.array(x[own], mask=None if missing is None else missing[own]))
    return kept


def features(placed: DataFrame, long: int = 1440, short: int = 60, rows: int = 1 << 16) -> DataFrame:
    """symbol, event_time_ns, pos, n with ret, skew, kurt, gk_vol, volume_ratio, decoupling, pk_vol.

    A bucket of rows with its halo is a task's group of bounded size, computed as arrays. Every window is merged from two spans
    of blocks (operators.moments), so a row costs the same whatever the window's length, and what has left a window leaves nothing behind.
    A return that is no number makes the windows over it invalid, so does one without variance (a halt): skew and kurt are null there.
    """
    x = with_halo(placed.select("symbol", "event_time_ns", "pos", "n", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]), long + 1, rows)
    schema = x.select("symbol", "event_time_ns", "pos", "n").schema
    for c in ("ret", "skew", "kurt", "gk_vol", "pk_vol", "volume_ratio", "ret_short", "decoupling"):
        schema = schema.add(c, "double")
    return x.groupBy("symbol", "bucket").applyInArrow(lambda table: _features(table, long, short), schema)
