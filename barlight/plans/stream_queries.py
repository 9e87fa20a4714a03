"""Streams replayed over the events table, with the batch question in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.plans import text_queries
from barlight.plans.bar_queries import BASE, HOURLY, HOURS, SIGNAL_OUT, TOP, features_sql, hits_sql, kept_sql, rounded, signal_rows, sql, table
from barlight.sources.scratch import scratch_path
from barlight.streaming import streams

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = table(spark, sf_dir, "events").schema
    read = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


LAST = "(SELECT max(ts) FROM events)"


@query(text_queries.SQL["k10_duplicate_writes"].replace("SELECT hash, n_writes, unnest(kept)", "SELECT hash, unnest(kept)"))
def st1_accepted_writes(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("hash"), F.unix_micros("ts").alias("ts"))
    return streams.replayed(streams.accepted_writes(e, 12 * text_queries.HOUR)).drop("batch")


@query()
def st1_first_writes(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("hash"), "ts")
    return streams.replayed(streams.first_writes(e, "12 hours")).select("hash", F.unix_micros("ts").alias("ts"))


@query(text_queries.SQL["t9_reinforcement"])
def st2_reinforcement(spark, sf_dir):
    kinds = list(streams.lifecycle.DELTAS)
    e = events(spark, sf_dir)
    event = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5 + 1).cast("int"))
    given = e.select(F.col("user_id").alias("note"), event.alias("event"), F.when(F.col("event_id") % 2 == 0, "system").otherwise("user").alias("source"), "ts", "event_id")
    states = streams.replayed(streams.reinforced(given), "update")
    return states.groupBy("note").agg(F.max_by(F.struct("quality", "session_delta", "n_applied", "n_events"), "batch").alias("s")).select("note", "s.*")


@query("SELECT event_id, user_id, event_type FROM events")
def st3_tail(spark, sf_dir):
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").write.json(path)
    return streams.replayed(streams.tail(spark, path, "event_id long, user_id long, event_type string")).drop("batch")


@query(f"""WITH g AS (SELECT user_id AS run_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT run_id, epoch_us(min(ts)) AS started_at, epoch_us(max(ts)) AS last_event, count(*) AS n_events FROM s GROUP BY run_id, n HAVING max(ts) + INTERVAL 12 HOUR <= {LAST} - INTERVAL 1 MINUTE""")
def st4_silences(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("run_id"), "ts")
    out = streams.replayed(streams.silences(e, "12 hours"))
    return out.select("run_id", F.unix_micros("started_at").alias("started_at"), F.unix_micros("last_event").alias("last_event"), "n_events")


RUNS = "SELECT DISTINCT user_id AS run_id, user_id % 50 * 120.0 AS heartbeat, 600 * (1 + user_id % 7) AS timeout, user_id % 4 AS retries FROM events"


@query(f"""WITH runs AS ({RUNS}), e AS (SELECT run_id, ts, greatest(60.0, least(greatest(60.0, heartbeat * 10), timeout * (retries + 1) + 60)) AS allowed FROM events JOIN runs ON user_id = run_id),
g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= allowed * 1000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT run_id, epoch_us(min(ts)) AS started_at, epoch_us(max(ts)) AS last_event, count(*) AS n_events FROM s GROUP BY run_id, k, allowed HAVING epoch_us(max(ts)) + allowed * 1000000 < epoch_us({LAST}) - 60000000""")
def st4_silent_runs(spark, sf_dir):
    """Runs (the users) that fall silent for longer than their own limit."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("run_id"), "ts")
    runs = table(spark, sf_dir, "events").selectExpr("user_id as run_id", "user_id % 50 * 120.0D as heartbeat", "600 * (1 + user_id % 7) as timeout", "user_id % 4 as retries").distinct()
    return streams.replayed(streams.silent_runs(e, runs)).drop("batch")


@query(sql(HOURS, select=f"SELECT symbol, event_time_ns, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, volume FROM bars WHERE event_time_ns + 3600000000000 <= epoch_ns({LAST}) - 60000000000"))
def st5_bars(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    return rounded(streams.replayed(streams.bars(e, "1 hour")).drop("batch"))


PLACED = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time_ns) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars
  WHERE event_time_ns + 3600000000000 <= epoch_ns({LAST}) - 60000000000)"""
FEATURES = ["ret", "skew", "kurt", "gk_vol", "volume_ratio", "decoupling"]


@query(sql(HOURS, PLACED, features_sql(24, 6), select="SELECT symbol, event_time_ns, pos, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM feat"))
def st6_features(spark, sf_dir):
    """Rolling features of a stream of bars that itself comes from ticks."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    made = streams.features(streams.bars(e, "1 hour"), long=24, short=6)
    return rounded(made.select("symbol", "event_time_ns", "pos", *FEATURES), 6)


RANKS = "[" + ", ".join(f"{i / 1024}" for i in range(1, 1025)) + "]"
NAMES = ["skew", "kurt", "gk_vol", "decoupling"]
SKETCHED = (
    "q AS (SELECT symbol, count(skew) AS valid_skew, " + ", ".join(f"quantile_disc({c}, 0.5) AS med_{c}, quantile_disc({c}, {RANKS}) AS q_{c}" for c in NAMES) + " FROM feat GROUP BY symbol),"
    "med AS (SELECT symbol, valid_skew, " + ", ".join(f"med_{c}" for c in NAMES) + " FROM q),"
    "mad AS (SELECT symbol, " + ", ".join(f"list_sort(list_transform(q_{c}, lambda x: abs(x - med_{c})))[512] AS mad_{c}" for c in NAMES) + " FROM q)," + BASE[BASE.index("z AS ("):])


@query(sql(HOURS, PLACED, features_sql(24, 6), SKETCHED, hits_sql(HOURLY), kept_sql(HOURLY), TOP, select=f"SELECT {SIGNAL_OUT} FROM top"))
def st7_signals(spark, sf_dir):
    """The scan of a stream of bars that itself comes from ticks: the signals after its last batch."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    found = streams.signals(streams.bars(e, "1 hour"), p=replace(HOURLY, exact=False))
    last = found.agg(F.max("batch").alias("batch"))
    return signal_rows(found.join(F.broadcast(last), "batch"))
