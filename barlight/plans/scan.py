"""The bar scan: features, robust z-scores, suppression, top list; persistence check; hypothesis report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions import bars as fb
from barlight.operators import baseline, quality, rolling, suppress
from barlight.sources import bars as source
from barlight.sources.scratch import cleared, materialise


@dataclass(frozen=True)
class ScanParams:
    """Defaults are the published constants of the scan."""

    long: int = 1440
    short: int = 60
    gap: int = 60
    keep: int = 10
    z_moment: float = 2.0
    z_volatility: float = 2.5
    z_decoupling: float = 3.0
    least_total: int = 100
    least_short: int = 120
    least_windows: int = 60
    per_symbol: int = 10
    total: int = 50
    rows_per_bucket: int = 1 << 16
    exact: bool = True
    gap_ns: int | None = None  # windows end at gaps between bars that are longer than this; None: they run over them
    warmup: str = "reference"  # exclude: the first `short` rows have no return and are left out of A3


@dataclass(frozen=True)
class Scanner:
    """What a scanner calls its signals; score gives (z, value, valid) from scored features."""

    key: str
    stat: str
    label: str
    raw_columns: tuple[str, ...]
    feature_names: tuple[str, ...]
    window: str
    score: Callable[[ScanParams], tuple[Column, Column, Column]]


def _moment(p: ScanParams) -> tuple[Column, Column, Column]:
    skew_wins = F.abs("z_skew") >= F.abs("z_kurt")
    z = F.when(skew_wins, F.col("z_skew")).otherwise(F.col("z_kurt"))
    gate = (F.col("n") >= p.long) & (F.col("valid_skew") >= p.least_windows)
    return z, F.when(skew_wins, F.col("skew")).otherwise(F.col("kurt")), gate & valid("skew") & (F.abs(z) > p.z_moment)


def _volatility(p: ScanParams) -> tuple[Column, Column, Column]:
    z = F.col("z_gk_vol")
    return z, F.col("gk_vol"), (F.col("n") >= p.least_short) & valid("gk_vol") & (F.abs(z) > p.z_volatility)


def _decoupling(p: ScanParams) -> tuple[Column, Column, Column]:
    z = F.col("z_decoupling")
    return z, F.col("decoupling"), (F.col("n") >= p.least_short) & valid("decoupling") & (z > p.z_decoupling)


SCANNERS: dict[str, Scanner] = {}


def register(scanner: Scanner) -> None:
    SCANNERS[scanner.key] = scanner


register(Scanner("A1", "moment_shift", "moment", ("close",), ("return_skewness_24h", "return_kurtosis_24h"), "24h", _moment))
register(Scanner("A2", "volatility_jump", "vol", ("open", "high", "low", "close"), ("volatility_garman_klass_1h", "volatility_parkinson_1h", "gk_parkinson_ratio"), "1h", _volatility))
register(Scanner("A3", "volume_price_decoupling", "voldecouple", ("close", "volume"), ("return_1h", "volume_ratio_1h", "return_volume_correlation_24h"), "1h", _decoupling))


def valid(column: str) -> Column:
    if column in ("skew", "kurt"):
        return fb.finite(F.col("skew")) & fb.finite(F.col("kurt"))
    return fb.finite(F.col(column))


def scored(placed: DataFrame, p: ScanParams, keys: list[str]) -> DataFrame:
    """Features with their z-scores, no rows if there are fewer bars than least_total. They are written once: medians, deviations and scores read them."""
    needed = [c for c, k in (("skew", "A1"), ("kurt", "A1"), ("gk_vol", "A2"), ("decoupling", "A3")) if k in keys]
    windows = (p.long, p.short, p.rows_per_bucket)
    features = quality.features_by_segment(placed, p.gap_ns, *windows) if p.gap_ns else rolling.features(placed, *windows)
    made = materialise(features.select("symbol", "event_time_ns", "pos", "n", *needed), "features")
    if made.limit(p.least_total).count() < p.least_total:
        made = made.where("false")  # source.outcome gives the reason
    ok = {c: valid(c) for c in needed}
    if p.warmup == "exclude" and "decoupling" in ok:
        ok["decoupling"] = ok["decoupling"] & (F.col("pos") >= p.short)
    return baseline.scored(made, ok, p.exact)


def signals(placed: DataFrame, p: ScanParams = ScanParams(), keys: list[str] | None = None) -> DataFrame:
    """Suppressed signals of the scanners with these keys (all registered): signal rows with scanner and pos; none if there are too few bars."""
    keys = keys or list(SCANNERS)
    return suppressed(scored(placed, p, keys), p, keys)


def suppressed(rows: DataFrame, p: ScanParams, keys: list[str]) -> DataFrame:
    """Signals of rows with features, baselines and z-scores."""
    each = []
    for i, k in enumerate(keys):
        z, value, ok = SCANNERS[k].score(p)
        each.append(F.when(ok, F.struct(F.lit(k).alias("scanner"), z.alias("effect_size"), value.alias("value"))))
    hits = rows.select("symbol", "event_time_ns", "pos", F.explode(F.array_compact(F.array(*each))).alias("s"))
    hits = hits.select("symbol", "s.scanner", "event_time_ns", "pos", "s.effect_size", "s.value", F.abs("s.effect_size").alias("strength"))
    return formatted(suppress.suppress(hits, ["symbol", "scanner"], keep=p.keep, gap=p.gap))


def iso() -> Column:
    """UTC time as ISO text, whatever the session's time zone; microseconds only where there are any."""
    us = F.expr("event_time_ns div 1000")
    plain = F.expr("cast(timestampadd(MICROSECOND, event_time_ns div 1000, timestamp_ntz'1970-01-01 00:00:00') as string)")
    tail = F.when(us % 1_000_000 != 0, F.concat(F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.concat(F.replace(F.left(plain, F.lit(19)), F.lit(" "), F.lit("T")), tail, F.lit("+00:00"))


def formatted(kept: DataFrame) -> DataFrame:
    def by(make) -> Column:
        out = F.lit(None)
        for s in SCANNERS.values():
            out = F.when(F.col("scanner") == s.key, make(s)).otherwise(out)
        return out

    return kept.select(
        F.concat_ws("_", "scanner", "symbol", by(lambda s: F.lit(s.label)), F.col("pos").cast("string")).alias("signal_id"),
        "symbol", by(lambda s: F.lit(s.stat)).alias("stat"),
        by(lambda s: F.array(*map(F.lit, s.raw_columns))).alias("raw_columns"), by(lambda s: F.array(*map(F.lit, s.feature_names))).alias("feature_names"),
        "value", "effect_size", iso().alias("observed_at"), by(lambda s: F.lit(s.window)).alias("window"), "scanner", "pos",
    )


SIGNAL = ["signal_id", "symbol", "stat", "raw_columns", "feature_names", "value", "effect_size", "observed_at", "window"]


def scan(bars: DataFrame, p: ScanParams = ScanParams(), **loading) -> DataFrame:
    """The full scan: at most 50 signals, at most 10 of a symbol; none if fewer than 100 bars are left (source.outcome says so)."""
    with cleared(bars.sparkSession) as keep:
        return keep(materialise(suppress.top(signals(source.load(bars, **loading), p), p.per_symbol, p.total), "signals"))


def persistence(bars: DataFrame, symbol: str, stat: str, least_z: float = 2.0, part: str = "full", p: ScanParams = ScanParams(), **loading) -> DataFrame:
    """One row: whether the symbol shows this statistic's anomaly in this segment."""
    placed = source.load(bars, symbols=[symbol], part=part, **loading)
    keys = [s.key for s in SCANNERS.values() if s.stat == stat] or None
    found = signals(placed, p, keys).where((F.col("stat") == stat) & (F.col("symbol") == symbol))
    best = found.agg(F.max_by(F.struct("effect_size", "value", "observed_at"), F.struct(F.abs("effect_size"), "pos")).alias("b"), F.count("*").alias("n"))
    z = F.col("b.effect_size")
    return best.select(
        F.coalesce(F.abs(z) >= least_z, F.lit(False)).alias("persisted"), F.lit(symbol).alias("symbol"), F.lit(stat).alias("stat"), F.lit(part).alias("segment"),
        F.coalesce(F.bround(z, 2), F.lit(0.0)).alias("z_score"), F.bround("b.value", 4).alias("measured_value"), F.col("b.observed_at").alias("observed_at"), F.col("n").alias("total_occurrences"),
    )


# The texts of the template hypothesis.
NARRATIVE = "Abnormal price volatility and volume surge indicate temporary price overextension. As extreme buying/selling momentum cools down, price action systematically mean-reverts back to historical moving averages."
REASONING = "Default fallback hypothesis synthesis for extreme anomaly."


def hypotheses(found: DataFrame, most: int = 5) -> DataFrame:
    """Template hypotheses of the first signals in rank order."""
    first = found.orderBy(F.desc(F.abs("effect_size")), "scanner", "symbol", "pos").limit(most)
    return first.select(
        F.concat(F.lit("hyp_"), "signal_id").alias("hypothesis_id"),
        F.concat_ws(" ", "symbol", F.initcap(F.replace("stat", F.lit("_"), F.lit(" "))), F.lit("Price Reversion")).alias("title"),
        F.format_string("Extreme %s anomaly (z=%.2f) on %s indicates temporary price overextension leading to short-horizon mean reversion.", "stat", "effect_size", "symbol").alias("hypothesis_text"),
        F.lit(NARRATIVE).alias("narrative"), "symbol", "stat", "effect_size",
        F.when(F.col("effect_size") > 0, -1).otherwise(1).alias("predicted_sign"), F.col("raw_columns").alias("mechanism_columns"),
        F.lit("HIGH_VOLATILITY").alias("target_regime"), F.lit("1h").alias("target_horizon"), F.lit("GENERATE_HYPOTHESIS").alias("next_action"), F.lit(REASONING).alias("action_reasoning"),
    )


def report(found: DataFrame, most: int = 5) -> DataFrame:
    """One document: status, counts, signals and hypotheses as nested arrays (at most 50 and `most`)."""
    rows = found.agg(F.sort_array(F.collect_list(F.struct(*SIGNAL))).alias("signals"), F.count("*").alias("n_signals"))
    made = hypotheses(found, most).agg(F.sort_array(F.collect_list(F.struct("hypothesis_id", "title", "symbol", "stat", "effect_size", "predicted_sign"))).alias("hypotheses"))
    both = rows.join(F.broadcast(made), F.lit(True))
    return both.select(F.when(F.col("n_signals") > 0, "ok").otherwise("warning").alias("status"), F.when(F.col("n_signals") == 0, "no anomaly passed the thresholds").alias("reason"), "n_signals", "signals", "hypotheses")


def write_report(found: DataFrame, path: str, most: int = 5) -> None:
    report(found, most).write.mode("overwrite").json(path)
