"""Queries on bars derived from the given tables, with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.functions import bars as fb
from barlight.operators import baseline, quality, rolling, suppress
from barlight.plans import scan as plan
from barlight.sources import bars as source
from barlight.sources import sidecars
from barlight.sources.scratch import cleared, materialise, scratch_path

P = plan.ScanParams()
HOURLY = plan.ScanParams(long=24, short=6, gap=6, least_short=48, least_windows=24)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_lineitem(table(spark, sf_dir, "lineitem"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_events(table(spark, sf_dir, "events"))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- SQL parts ----

DAILY = """
t AS (SELECT *, l_extendedprice / l_quantity AS p,
        row_number() OVER (PARTITION BY l_returnflag, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn,
        count(*) OVER (PARTITION BY l_returnflag, l_shipdate) AS k FROM lineitem),
bars AS (SELECT l_returnflag AS symbol, epoch_ns(l_shipdate) AS event_time_ns, max(CASE WHEN rn = 1 THEN p END) AS open, max(p) AS high, min(p) AS low,
        max(CASE WHEN rn = k THEN p END) AS close, sum(l_quantity) AS volume FROM t GROUP BY l_returnflag, l_shipdate)"""
HOURS = """
t AS (SELECT event_type, date_trunc('hour', ts) AS h, value AS p, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn,
        count(*) OVER (PARTITION BY event_type, date_trunc('hour', ts)) AS k FROM events),
bars AS (SELECT event_type AS symbol, epoch_ns(h) AS event_time_ns, max(CASE WHEN rn = 1 THEN p END) AS open, max(p) AS high, min(p) AS low,
        max(CASE WHEN rn = k THEN p END) AS close, CAST(count(*) AS DOUBLE) AS volume FROM t GROUP BY event_type, h)"""
PLACED = """
placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time_ns) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"""


def features_sql(long: int, short: int, placed: str = "placed") -> str:
    w = "PARTITION BY symbol ORDER BY pos"
    return f"""
f1 AS (SELECT *, ln(close) - lag(ln(close)) OVER ({w}) AS ret, pow(ln(greatest(high, 1e-8) / greatest(low, 1e-8)), 2) AS hl2, pow(ln(greatest(close, 1e-8) / greatest(open, 1e-8)), 2) AS co2,
        coalesce(close / lag(close, {short}) OVER ({w}) - 1, 0) AS ret_short FROM {placed}),
f2 AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol) AS c, greatest(0.5 * hl2 - (2 * ln(2) - 1) * co2, 0) AS gk FROM f1),
f3 AS (SELECT *, count(c) OVER lw AS k, avg(c) OVER lw AS e1, avg(c * c) OVER lw AS e2, avg(c * c * c) OVER lw AS e3, avg(c * c * c * c) OVER lw AS e4,
        sqrt(greatest(avg(gk) OVER sw, 1e-10)) AS gk_vol, sqrt(greatest(avg(hl2 / (4 * ln(2))) OVER sw, 1e-10)) AS pk_vol,
        volume / greatest(avg(volume) OVER sw, 1e-4) AS volume_ratio
        FROM f2 WINDOW lw AS ({w} ROWS BETWEEN {long - 1} PRECEDING AND CURRENT ROW), sw AS ({w} ROWS BETWEEN {short - 1} PRECEDING AND CURRENT ROW)),
f4 AS (SELECT *, e2 - e1 * e1 AS v FROM f3),
feat AS (SELECT symbol, event_time_ns, pos, n, ret, CASE WHEN k = {long} AND v > 0 THEN (e3 - 3 * e1 * e2 + 2 * e1 * e1 * e1) / pow(v, 1.5) END AS skew,
        CASE WHEN k = {long} AND v > 0 THEN (e4 - 4 * e1 * e3 + 6 * e1 * e1 * e2 - 3 * e1 * e1 * e1 * e1) / (v * v) - 3 END AS kurt,
        gk_vol, pk_vol, volume_ratio, ret_short, volume_ratio / (abs(ret_short) + 1e-3) AS decoupling FROM f4)"""


BASE = """
med AS (SELECT symbol, median(skew) AS med_skew, median(kurt) AS med_kurt, median(gk_vol) AS med_gk_vol, median(decoupling) AS med_decoupling, count(skew) AS valid_skew FROM feat GROUP BY symbol),
mad AS (SELECT symbol, median(abs(skew - med_skew)) AS mad_skew, median(abs(kurt - med_kurt)) AS mad_kurt, median(abs(gk_vol - med_gk_vol)) AS mad_gk_vol,
        median(abs(decoupling - med_decoupling)) AS mad_decoupling FROM feat JOIN med USING (symbol) GROUP BY symbol),
z AS (SELECT feat.*, med.* EXCLUDE (symbol), mad.* EXCLUDE (symbol), coalesce(0.6745 * (skew - med_skew) / greatest(mad_skew, 1e-4), 0) AS z_skew, coalesce(0.6745 * (kurt - med_kurt) / greatest(mad_kurt, 1e-4), 0) AS z_kurt,
        0.6745 * (gk_vol - med_gk_vol) / greatest(mad_gk_vol, 1e-4) AS z_gk_vol, 0.6745 * (decoupling - med_decoupling) / greatest(mad_decoupling, 1e-4) AS z_decoupling
        FROM feat JOIN med USING (symbol) JOIN mad USING (symbol))"""


def hits_sql(p: plan.ScanParams) -> str:
    return f"""
hits AS (
  SELECT symbol, 'A1' AS scanner, event_time_ns, pos, CASE WHEN abs(z_skew) >= abs(z_kurt) THEN z_skew ELSE z_kurt END AS effect_size, CASE WHEN abs(z_skew) >= abs(z_kurt) THEN skew ELSE kurt END AS value
  FROM z WHERE n >= {p.long} AND valid_skew >= {p.least_windows} AND skew IS NOT NULL AND greatest(abs(z_skew), abs(z_kurt)) > {p.z_moment}
  UNION ALL SELECT symbol, 'A2', event_time_ns, pos, z_gk_vol, gk_vol FROM z WHERE n >= {p.least_short} AND abs(z_gk_vol) > {p.z_volatility}
  UNION ALL SELECT symbol, 'A3', event_time_ns, pos, z_decoupling, decoupling FROM z WHERE n >= {p.least_short} AND z_decoupling > {p.z_decoupling})"""


def kept_sql(p: plan.ScanParams) -> str:
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, scanner ORDER BY abs(effect_size) DESC, pos DESC) AS r FROM hits),
folded AS (SELECT symbol, scanner, list_reduce(list([pos] ORDER BY r), lambda a, x: CASE WHEN len(a) < {p.keep} AND len(list_filter(a, lambda q: abs(q - x[1]) < {p.gap})) = 0 THEN list_concat(a, x) ELSE a END) AS kept
  FROM ranked WHERE r <= {suppress.prune_limit(p.keep, p.gap)} GROUP BY symbol, scanner),
kept AS (SELECT hits.* FROM hits JOIN folded USING (symbol, scanner) WHERE list_contains(kept, pos)),
signals AS (SELECT scanner || '_' || symbol || '_' || CASE scanner WHEN 'A1' THEN 'moment' WHEN 'A2' THEN 'vol' ELSE 'voldecouple' END || '_' || CAST(pos AS VARCHAR) AS signal_id,
  symbol, CASE scanner WHEN 'A1' THEN 'moment_shift' WHEN 'A2' THEN 'volatility_jump' ELSE 'volume_price_decoupling' END AS stat,
  CASE scanner WHEN 'A1' THEN 'close' WHEN 'A2' THEN 'open,high,low,close' ELSE 'close,volume' END AS raw_columns,
  value, effect_size, strftime(make_timestamp_ns(event_time_ns), '%Y-%m-%dT%H:%M:%S+00:00') AS observed_at, CASE scanner WHEN 'A1' THEN '24h' ELSE '1h' END AS "window", scanner, pos FROM kept)"""


TOP = """
firsts AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(effect_size) DESC, scanner, symbol, pos) AS r FROM signals),
top AS (SELECT * FROM firsts WHERE r <= 10 ORDER BY abs(effect_size) DESC, scanner, symbol, pos LIMIT 50)"""
SIGNAL_OUT = 'signal_id, symbol, stat, raw_columns, round(value, 6) AS value, round(effect_size, 6) AS effect_size, observed_at, "window"'


def sql(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def chain(p: plan.ScanParams = P, base: str = DAILY, placed: str = PLACED) -> list[str]:
    return [base, placed, features_sql(p.long, p.short), BASE, hits_sql(p), kept_sql(p)]


def signal_rows(df: DataFrame) -> DataFrame:
    """Arrays as text, floats rounded: what the SQL side gives."""
    return rounded(df.select("signal_id", "symbol", "stat", F.array_join("raw_columns", ",").alias("raw_columns"), "value", "effect_size", "observed_at", "window"), 6)


def segment_sql(part: str) -> str:
    cut = {"in_sample": "WHERE pos0 < n0 // 2", "out_of_sample": "WHERE pos0 >= n0 - n0 // 2", "full": ""}[part]
    return f"""
all_placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time_ns) - 1 AS pos0, count(*) OVER (PARTITION BY symbol) AS n0 FROM bars),
placed AS (SELECT * EXCLUDE (pos0, n0), row_number() OVER (PARTITION BY symbol ORDER BY event_time_ns) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM all_placed {cut})"""


QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


BAR = "symbol, event_time_ns, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, volume"


@query(sql(DAILY, select=f"SELECT {BAR} FROM bars"))
def s1_bar_files(spark, sf_dir):
    """Write one folder a symbol, then scan them all at once."""
    path = scratch_path(spark, "bars")
    daily(spark, sf_dir).write.partitionBy("symbol").parquet(path)
    return rounded(source.read(spark, path))


@query(sql(DAILY, select=f"SELECT {BAR} FROM bars WHERE symbol <> 'R' UNION ALL SELECT {BAR.replace(', volume', ', NULL AS volume')} FROM bars WHERE symbol = 'R'"))
def s2_union_of_schemas(spark, sf_dir):
    b = daily(spark, sf_dir)
    return rounded(source.union([b.where("symbol <> 'R'"), b.where("symbol = 'R'").drop("volume")]))


@query(sql(DAILY, select="SELECT DISTINCT upper(trim(symbol)) AS symbol FROM bars"))
def s4_registry(spark, sf_dir):
    return source.registry(daily(spark, sf_dir))


@query(sql(HOURS, select=f"SELECT {BAR} FROM bars"))
def s1_hour_bars(spark, sf_dir):
    return rounded(hourly(spark, sf_dir))


@query(sql(DAILY, select=f"SELECT {BAR} FROM bars JOIN (SELECT symbol, max(event_time_ns) AS m FROM bars GROUP BY symbol) USING (symbol) WHERE event_time_ns >= m - 730 * 86400000000000"))
def f1_lookback(spark, sf_dir):
    return rounded(source.lookback(daily(spark, sf_dir), 730))


@query(sql(DAILY, select=f"SELECT {BAR} FROM bars WHERE event_time_ns BETWEEN epoch_ns(TIMESTAMP '1996-01-01') AND epoch_ns(TIMESTAMP '1997-06-30 12:00:00')"))
def f2_date_range(spark, sf_dir):
    return rounded(source.date_range(daily(spark, sf_dir), "1996-01-01T00:00:00Z", "1997-06-30T12:00:00Z"))


@query(sql(DAILY, select=f"SELECT {BAR} FROM bars WHERE symbol IN ('A', 'N')"))
def f3_universe(spark, sf_dir):
    return rounded(source.universe(daily(spark, sf_dir), ["A", "N"]))


@query(sql(DAILY, select="SELECT CASE WHEN count(*) < 100 THEN 'insufficient_data' ELSE 'pass' END AS outcome, count(*) AS n_rows, CASE WHEN count(*) < 100 THEN 'fewer than 100 bars' END AS reason FROM bars"))
def f4_outcome(spark, sf_dir):
    return source.outcome(source.load(daily(spark, sf_dir)))


@query(sql(HOURS, PLACED, features_sql(24, 6), select="""SELECT symbol, count(*) AS n, count(skew) AS windows, count(*) >= 24 AND count(skew) >= 24 AS a1_runs, count(*) >= 48 AS a2_runs FROM feat GROUP BY symbol"""))
def f4_symbol_gates(spark, sf_dir):
    f = rolling.features(source.load(hourly(spark, sf_dir)), 24, 6)
    n, k = F.count("*"), F.count_if(plan.valid("skew"))
    return f.groupBy("symbol").agg(n.alias("n"), k.alias("windows"), ((n >= 24) & (k >= 24)).alias("a1_runs"), (n >= 48).alias("a2_runs"))


@query(sql(DAILY, PLACED, select="""SELECT symbol, event_time_ns, pos, n, CASE WHEN pos < n // 2 THEN 'in_sample' WHEN pos >= n - n // 2 THEN 'out_of_sample' ELSE 'neither' END AS part FROM placed"""))
def f7_segments(spark, sf_dir):
    p = source.load(daily(spark, sf_dir))
    half = F.expr("n div 2")
    part = F.when(F.col("pos") < half, "in_sample").when(F.col("pos") >= F.col("n") - half, "out_of_sample").otherwise("neither")
    return p.select("symbol", "event_time_ns", "pos", "n", part.alias("part"))


TWICE = """
twice AS (SELECT l_returnflag AS symbol, epoch_ns(l_shipdate) AS event_time_ns, l_extendedprice AS open, l_extendedprice AS high, l_extendedprice AS low, l_extendedprice AS close, l_quantity AS volume FROM lineitem),
one AS (SELECT *, row_number() OVER (PARTITION BY symbol, event_time_ns ORDER BY open, high, low, close, volume) AS r FROM twice)"""


@query(sql(TWICE, select="SELECT symbol, event_time_ns, open, high, low, close, volume FROM one WHERE r = 1"))
def k1_deduplicate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    raw = li.select(F.col("l_returnflag").alias("symbol"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("event_time_ns"), *[price.alias(c) for c in ("open", "high", "low", "close")], F.col("l_quantity").alias("volume"))
    return source.deduplicate(raw).drop("slice")


@query(sql(DAILY, PLACED, select="SELECT symbol, event_time_ns, pos, n FROM placed"))
def w5_positions(spark, sf_dir):
    return source.positions(source.deduplicate(daily(spark, sf_dir))).select("symbol", "event_time_ns", "pos", "n")


FEATURE_OUT = "symbol, pos, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("ret", "skew", "kurt", "gk_vol", "pk_vol", "volume_ratio", "ret_short", "decoupling"))


@query(sql(DAILY, PLACED, features_sql(1440, 60), select=f"SELECT {FEATURE_OUT} FROM feat"))
def w2_w4_features(spark, sf_dir):
    """Rolling skewness, kurtosis, volatilities, volume ratio, returns and decoupling."""
    return rounded(rolling.features(source.load(daily(spark, sf_dir))), 6).drop("event_time_ns", "n")


@query(sql(DAILY, PLACED, features_sql(1440, 60), select=f"SELECT {FEATURE_OUT} FROM feat"))
def w2_w4_features_in_buckets(spark, sf_dir):
    """The same from buckets of 1,500 rows with halo: what a long series runs through."""
    return rounded(rolling.features(source.load(daily(spark, sf_dir)), rows=1500), 6).drop("event_time_ns", "n")


@query(sql(DAILY, PLACED, select="""SELECT symbol, event_time_ns, round(greatest(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2), 0), 8) AS gk, round(pow(ln(high / low), 2) / (4 * ln(2)), 8) AS pk FROM placed"""))
def p2_range_variances(spark, sf_dir):
    b = daily(spark, sf_dir)
    gk, pk = fb.garman_klass(F.col("open"), F.col("high"), F.col("low"), F.col("close")), fb.parkinson(F.col("high"), F.col("low"))
    return b.select("symbol", "event_time_ns", F.round(gk, 8).alias("gk"), F.round(pk, 8).alias("pk"))


COLUMNS = ["skew", "kurt", "gk_vol", "decoupling"]


@query(sql(DAILY, PLACED, features_sql(1440, 60), BASE, select="SELECT med.symbol, " + ", ".join(f"round(med_{c}, 6) AS med_{c}, round(mad_{c}, 6) AS mad_{c}" for c in COLUMNS) + ", valid_skew FROM med JOIN mad ON med.symbol = mad.symbol"))
def g1_g2_baselines(spark, sf_dir):
    f = rolling.features(source.load(daily(spark, sf_dir)))
    out = baseline.baselines(f, {c: plan.valid(c) for c in COLUMNS})
    return rounded(out.select("symbol", *[f"{m}_{c}" for c in COLUMNS for m in ("med", "mad")], "valid_skew"), 6)


@query(sql(DAILY, PLACED, features_sql(1440, 60), BASE, select="SELECT symbol, pos, " + ", ".join(f"round(z_{c}, 5) AS z_{c}" for c in COLUMNS) + " FROM z"))
def p7_robust_z(spark, sf_dir):
    return rounded(plan.scored(source.load(daily(spark, sf_dir)), P, ["A1", "A2", "A3"]).select("symbol", "pos", *[f"z_{c}" for c in COLUMNS]), 5)


@query(sql(*chain()[:5], select="SELECT symbol, scanner, count(*) AS n, round(max(abs(effect_size)), 6) AS strongest FROM hits GROUP BY symbol, scanner"))
def f6_candidates(spark, sf_dir):
    rows = plan.scored(source.load(daily(spark, sf_dir)), P, list(plan.SCANNERS))
    each = [F.when(ok, F.struct(F.lit(k).alias("scanner"), z.alias("z"))) for k, s in plan.SCANNERS.items() for z, _, ok in [s.score(P)]]
    hits = rows.select("symbol", F.explode(F.array_compact(F.array(*each))).alias("s"))
    return hits.groupBy("symbol", "s.scanner").agg(F.count("*").alias("n"), F.round(F.max(F.abs("s.z")), 6).alias("strongest"))


def scanner_query(key: str):
    def run(spark, sf_dir):
        return signal_rows(plan.signals(source.load(daily(spark, sf_dir)), P, [key]))

    return run


for _key, _name in (("A1", "a1_moment_shift"), ("A2", "a2_volatility_jump"), ("A3", "a3_volume_price_decoupling")):
    QUERIES[_name] = scanner_query(_key)
    SQL[_name] = sql(*chain(), select=f"SELECT {SIGNAL_OUT} FROM signals WHERE scanner = '{_key}'")


@query(sql(*chain(), TOP, select=f"SELECT {SIGNAL_OUT} FROM top"))
def a4_full_scan(spark, sf_dir):
    return signal_rows(plan.scan(daily(spark, sf_dir)))


@query(sql(*chain(HOURLY, HOURS), TOP, select=f"SELECT {SIGNAL_OUT} FROM top"))
def a4_hourly_scan(spark, sf_dir):
    return signal_rows(plan.scan(hourly(spark, sf_dir), HOURLY))


def persistence_query(part: str, stat: str):
    def run(spark, sf_dir):
        return plan.persistence(daily(spark, sf_dir), "A", stat, part=part)

    return run


def persistence_sql(part: str, stat: str) -> str:
    return sql(*chain(placed=segment_sql(part)), f"mine AS (SELECT * FROM signals WHERE symbol = 'A' AND stat = '{stat}')", select=f"""
SELECT coalesce(max(abs(effect_size)) >= 2, false) AS persisted, 'A' AS symbol, '{stat}' AS stat, '{part}' AS segment, coalesce(round_even(arg_max(effect_size, abs(effect_size)), 2), 0) AS z_score,
  round_even(arg_max(value, abs(effect_size)), 4) AS measured_value, arg_max(observed_at, abs(effect_size)) AS observed_at, count(*) AS total_occurrences FROM mine""")


for _part in ("full", "in_sample", "out_of_sample"):
    for _stat in ("volatility_jump", "volume_price_decoupling", *(("moment_shift", "unknown_stat") if _part == "full" else ())):
        _name = f"a5_{_part}_{_stat}"
        QUERIES[_name], SQL[_name] = persistence_query(_part, _stat), persistence_sql(_part, _stat)


@query(sql(DAILY, PLACED, select=f"SELECT {BAR}, pos, n FROM placed WHERE symbol IN ('A', 'R')".replace("placed WHERE", "(SELECT * FROM placed) WHERE")))
def a6_load_and_clean(spark, sf_dir):
    out = source.load(daily(spark, sf_dir), symbols=["A", "R"])
    return rounded(out.select("symbol", "event_time_ns", "open", "high", "low", "close", "volume", "pos", "n"))


HYPOTHESES_SQL = sql(*chain(), TOP, "first AS (SELECT * FROM top ORDER BY abs(effect_size) DESC, scanner, symbol, pos LIMIT 5)", select=f"""
SELECT 'hyp_' || signal_id AS hypothesis_id, symbol || ' ' || CASE stat WHEN 'moment_shift' THEN 'Moment Shift' WHEN 'volatility_jump' THEN 'Volatility Jump' ELSE 'Volume Price Decoupling' END || ' Price Reversion' AS title,
  'Extreme ' || stat || ' anomaly (z=' || printf('%.2f', effect_size) || ') on ' || symbol || ' indicates temporary price overextension leading to short-horizon mean reversion.' AS hypothesis_text,
  symbol, stat, round(effect_size, 6) AS effect_size, CASE WHEN effect_size > 0 THEN -1 ELSE 1 END AS predicted_sign, raw_columns AS mechanism_columns,
  '{plan.NARRATIVE.replace("'", "''")}' AS narrative, '{plan.REASONING.replace("'", "''")}' AS action_reasoning, 'HIGH_VOLATILITY' AS target_regime, '1h' AS target_horizon, 'GENERATE_HYPOTHESIS' AS next_action FROM first""")


@query(HYPOTHESES_SQL)
def p10_hypotheses(spark, sf_dir):
    made = plan.hypotheses(plan.scan(daily(spark, sf_dir)))
    return rounded(made.withColumn("mechanism_columns", F.array_join("mechanism_columns", ",")), 6)


@query(sql(*chain(), TOP, select="""SELECT CASE WHEN count(*) > 0 THEN 'ok' ELSE 'warning' END AS status, count(*) AS n_signals, coalesce(string_agg(signal_id, ',' ORDER BY signal_id), '') AS ids, least(count(*), 5) AS n_hypotheses FROM top"""))
def a7_report(spark, sf_dir):
    """The report document, written as JSON and read again."""
    path = scratch_path(spark, "report")
    plan.write_report(plan.scan(daily(spark, sf_dir)), path)
    doc = spark.read.json(path)
    return doc.select("status", "n_signals", F.array_join(F.sort_array(F.transform("signals", lambda s: s["signal_id"])), ",").alias("ids"), F.size("hypotheses").cast("long").alias("n_hypotheses"))


# ---- documented extensions on bars ----


@query(sql(HOURS, """
g AS (SELECT symbol, event_time_ns, event_time_ns - lag(event_time_ns) OVER (PARTITION BY symbol ORDER BY event_time_ns) AS d FROM bars)""", select="""
SELECT symbol, event_time_ns, CAST(sum(CASE WHEN d > 3600000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY event_time_ns) AS BIGINT) AS segment FROM g"""))
def x1_gap_segments(spark, sf_dir):
    return quality.gap_segments(source.load(hourly(spark, sf_dir)), 3_600_000_000_000).select("symbol", "event_time_ns", "segment")


SEGMENTED = """
seg AS (SELECT *, sum(CASE WHEN d > 3600000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY sym ORDER BY event_time_ns) AS s FROM (SELECT * EXCLUDE (symbol), symbol AS sym, event_time_ns - lag(event_time_ns) OVER (PARTITION BY symbol ORDER BY event_time_ns) AS d FROM bars)),
placed AS (SELECT *, sym || '/' || CAST(s AS BIGINT) AS symbol, row_number() OVER (PARTITION BY sym, s ORDER BY event_time_ns) - 1 AS pos, count(*) OVER (PARTITION BY sym, s) AS n FROM seg)"""


@query(sql(HOURS, SEGMENTED, features_sql(24, 6), select="SELECT split_part(symbol, '/', 1) AS symbol, event_time_ns, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("ret", "skew", "kurt", "gk_vol", "volume_ratio", "decoupling")) + " FROM feat"))
def x1_features_by_segment(spark, sf_dir):
    """Windows that end at gaps of more than an hour."""
    made = quality.features_by_segment(source.load(hourly(spark, sf_dir)), 3_600_000_000_000, 24, 6)
    return rounded(made.select("symbol", "event_time_ns", "ret", "skew", "kurt", "gk_vol", "volume_ratio", "decoupling"), 6)


MANIFEST = "gap_from % 7200000000000 = 0"


@query(sql(HOURS, """
g AS (SELECT symbol, lag(event_time_ns) OVER (PARTITION BY symbol ORDER BY event_time_ns) AS gap_from, event_time_ns AS gap_to FROM bars),
b AS (SELECT * FROM g WHERE gap_to - gap_from > 3600000000000),
m AS (SELECT symbol, gap_from, gap_to FROM b UNION ALL SELECT symbol, min(event_time_ns), min(event_time_ns) + 3600000000000 FROM bars GROUP BY symbol)""", select="""
SELECT symbol, gap_from, gap_to, 'no break in the bars' AS error FROM m WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = m.symbol AND b.gap_from < m.gap_to AND b.gap_to > m.gap_from)"""))
def x2_gap_manifest(spark, sf_dir):
    b = hourly(spark, sf_dir)
    breaks = quality.breaks(b, 3_600_000_000_000)
    false_one = b.groupBy("symbol").agg(F.min("event_time_ns").alias("gap_from")).withColumn("gap_to", F.col("gap_from") + 3_600_000_000_000)
    return quality.manifest_errors(breaks.unionByName(false_one), breaks)


@query(sql(HOURS, select=f"SELECT {BAR} FROM bars WHERE event_time_ns // 3600000000000 % 7 <> 0 AND event_time_ns // 3600000000000 % 11 <> 0"))
def x3_drop_bad_bars(spark, sf_dir):
    hour = F.expr("event_time_ns div 3600000000000")
    marked = hourly(spark, sf_dir).withColumn("is_gap_filled", hour % 7 == 0).withColumn("dq_flags", F.when(hour % 11 == 0, 4).otherwise(0))
    return rounded(source.drop_bad(marked).drop("is_gap_filled", "dq_flags"))


@query(sql(HOURS, """r AS (SELECT symbol, event_time_ns, close, ln(close) AS x FROM bars)""", select="""
SELECT symbol, event_time_ns, count(x) OVER w AS base_n, round(avg(x) OVER w, 6) AS base_mean, round(stddev_pop(x) OVER w, 5) AS base_sd FROM r
WINDOW w AS (PARTITION BY symbol ORDER BY event_time_ns RANGE BETWEEN 270000000000000 PRECEDING AND 10800000000001 PRECEDING)"""))
def x4_causal_baseline(spark, sf_dir):
    """Window of 72 hours that ends 3 hours before the bar, its end excluded."""
    made = quality.causal_baseline(hourly(spark, sf_dir).withColumn("x", F.log("close")), "x", 72 * 3_600_000_000_000, 3 * 3_600_000_000_000)
    return made.select("symbol", "event_time_ns", "base_n", F.round("base_mean", 6).alias("base_mean"), F.round("base_sd", 5).alias("base_sd"))


@query("""SELECT concat('S', l_suppkey) AS symbol, n_name AS venue, 'v' || (s_nationkey % 3) AS schema_version, count(*) AS n, round(sum(l_quantity), 2) AS volume
FROM lineitem LEFT JOIN (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0) ON l_suppkey = s_suppkey GROUP BY ALL""")
def s3_stamped_bars(spark, sf_dir):
    """Trades by supplier, stamped with venue and version from sidecars that tasks wrote and read; every fifth supplier has none."""
    owners = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_suppkey % 5 <> 0")
    symbol = lambda key: F.concat(F.lit("S"), F.col(key))
    with cleared(spark) as keep:
        root = scratch_path(spark, "sidecars")
        sidecars.write(owners.select(symbol("s_suppkey").alias("symbol"), F.col("n_name").alias("venue"), F.concat(F.lit("v"), F.col("s_nationkey") % 3).alias("schema_version")), root)
        traded = table(spark, sf_dir, "lineitem").groupBy(symbol("l_suppkey").alias("symbol")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("volume"))
        return keep(materialise(sidecars.stamped(traded, sidecars.read(spark, root)), "stamped"))


@query("""WITH r AS (SELECT event_type AS symbol, epoch_ns(ts) AS event_time_ns, ln(1 + abs(value)) AS value FROM events)
SELECT symbol, event_time_ns, count(value) OVER w AS base_n, round(avg(value) OVER w, 6) AS base_mean, round(stddev_pop(value) OVER w, 5) AS base_sd FROM r
WINDOW w AS (PARTITION BY symbol ORDER BY event_time_ns RANGE BETWEEN 609000000000000 PRECEDING AND 4200000000001 PRECEDING)""")
def x4_baseline_of_ticks(spark, sf_dir):
    """Every event against the week that ends 70 minutes before it."""
    ticks = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("event_time_ns"), F.log1p(F.abs("value")).alias("value"))
    made = quality.causal_baseline(ticks, "value", 168 * 3_600_000_000_000, 70 * 60_000_000_000)
    return made.select("symbol", "event_time_ns", "base_n", F.round("base_mean", 6).alias("base_mean"), F.round("base_sd", 5).alias("base_sd"))


@query(sql(HOURS, """
v AS (SELECT symbol, event_time_ns, CASE WHEN event_time_ns // 3600000000000 % 5 <> 0 THEN close END AS x FROM bars),
i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time_ns) - row_number() OVER (PARTITION BY symbol, x IS NULL ORDER BY event_time_ns) AS island FROM v),
runs AS (SELECT symbol, count(*) AS k FROM i WHERE x IS NULL GROUP BY symbol, island)""", select="""
SELECT a.symbol, a.n_rows, a.n_valid, coalesce(b.longest, 0) AS longest_null_run, a.n_valid >= greatest(100, 0.8 * a.n_rows) AND coalesce(b.longest, 0) <= 0.1 * a.n_rows AS covered
FROM (SELECT symbol, count(*) AS n_rows, count(x) AS n_valid FROM v GROUP BY symbol) a LEFT JOIN (SELECT symbol, max(k) AS longest FROM runs GROUP BY symbol) b ON a.symbol = b.symbol"""))
def x5_coverage(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("x", F.when(F.expr("event_time_ns div 3600000000000 % 5") != 0, F.col("close")))
    return quality.coverage(b, "x", 100)


@query(sql(DAILY, """
d AS (SELECT DISTINCT symbol, event_time_ns // 86400000000000 AS day FROM bars),
i AS (SELECT symbol, day, day - row_number() OVER (PARTITION BY symbol ORDER BY day) AS island FROM d WHERE day >= 10000)""", select="""
SELECT symbol, max(k) AS longest_days, max(k) >= 30 AS can_confirm FROM (SELECT symbol, count(*) AS k FROM i GROUP BY symbol, island) GROUP BY symbol"""))
def x6_confirmation_days(spark, sf_dir):
    return quality.confirmation_days(daily(spark, sf_dir), 10_000, 30)


@query(sql(DAILY, PLACED, features_sql(1440, 60), select="""
SELECT symbol, pos, round(gk_vol / pk_vol, 6) AS ratio, CASE WHEN gk_vol / pk_vol > 2 THEN 'gap_driven' ELSE 'range_driven' END AS sub_type FROM feat"""))
def x13_parkinson_ratio(spark, sf_dir):
    f = rolling.features(source.load(daily(spark, sf_dir)))
    ratio = F.try_divide("gk_vol", "pk_vol")
    return f.select("symbol", "pos", F.round(ratio, 6).alias("ratio"), F.when(ratio > 2, "gap_driven").otherwise("range_driven").alias("sub_type"))


@query(sql(HOURS, """
r AS (SELECT symbol, event_time_ns, volume, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY event_time_ns) AS ret FROM bars)""", select="""
SELECT symbol, event_time_ns // 86400000000000 AS block, count(ret) AS n, round(CASE WHEN isnan(corr(ret, volume)) THEN NULL ELSE corr(ret, volume) END, 5) AS correlation FROM r GROUP BY 1, 2"""))
def x14_block_correlation(spark, sf_dir):
    """Return and volume within each day."""
    out = quality.block_correlation(hourly(spark, sf_dir), 86_400_000_000_000)
    return out.select("symbol", "block", "n", F.round(F.when(~F.isnan("correlation"), F.col("correlation")), 5).alias("correlation"))
