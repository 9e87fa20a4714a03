"""Bars: one scan of many symbols' Parquet files, union of partial schemas, registry and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.sources import sidecars

PRICES = "open double, high double, low double, close double, volume double"
BAR_SCHEMA = f"symbol string, event_time_ns long, {PRICES}"
DEFAULT_SYMBOLS = ["BTCUSDT", "ETHUSDT", "SOLUSDT", "BNBUSDT", "XRPUSDT"]  # fixed values: the universe if none is stored
DAY_NS = 86_400_000_000_000


def read(spark: SparkSession, root: str, symbols: list[str] | None = None) -> DataFrame:
    """Bars under root/<symbol>/**.parquet as one scan; columns that a file lacks are null, symbols without folder are absent."""
    found = spark.read.schema(f"event_time_ns long, {PRICES}").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    head = f"/{root.rstrip('/').rsplit('/', 1)[-1]}/"
    path = F.col("_metadata.file_path")
    below = F.substring(path, F.instr(path, head) + len(head), F.length(path))
    folder = F.substring_index(below, "/", 1)
    symbol = F.when(F.startswith(folder, F.lit("symbol=")), F.substring(folder, 8, 1 << 20)).otherwise(folder)
    out = found.withColumn("symbol", symbol).select("symbol", "event_time_ns", "open", "high", "low", "close", "volume")
    return universe(out, symbols) if symbols else out


def union(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; a column that one of them lacks is null there."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """The sidecar documents root/<symbol>/_metadata.json, under English column names."""
    found = sidecars.read(spark, root)
    return found.select("venue", "symbol", "schema_version", "compression", "source", F.try_to_timestamp("created_at").alias("created_at"))


def registry(bars: DataFrame, defaults: list[str] = DEFAULT_SYMBOLS) -> DataFrame:
    """Upper-cased symbols that have bars, hidden names left out; the defaults if there are none."""
    own = bars.select(F.upper(F.trim("symbol")).alias("symbol")).where("symbol <> '' and not startswith(symbol, '.')").distinct()
    spare = bars.sparkSession.createDataFrame([(s,) for s in defaults], "symbol string")
    any_own = own.agg(F.count("*").alias("_n"))
    return own.unionByName(spare.crossJoin(F.broadcast(any_own)).where("_n = 0").drop("_n"))  # five rows by one


def universe(bars: DataFrame, symbols: list[str]) -> DataFrame:
    return bars.where(F.col("symbol").isin(*symbols))


def lookback(bars: DataFrame, days: int) -> DataFrame:
    """Each symbol's last days, counted from its own latest bar; 0 and 3650 or more keep everything."""
    if days == 0 or days >= 3650:
        return bars
    last = bars.groupBy("symbol").agg(F.max("event_time_ns").alias("_last"))
    return bars.join(last, "symbol").where(F.col("event_time_ns") >= F.col("_last") - days * DAY_NS).drop("_last")


def date_range(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends inclusive, ISO text; a bound that is no date raises."""
    from datetime import UTC, datetime

    def ns(text: str) -> int:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
        at = at if at.tzinfo else at.replace(tzinfo=UTC)
        return int(at.timestamp()) * 1_000_000_000 + at.microsecond * 1000

    if start:
        bars = bars.where(F.col("event_time_ns") >= F.lit(ns(start)))
    if end:
        bars = bars.where(F.col("event_time_ns") <= F.lit(ns(end)))
    return bars


def drop_bad(bars: DataFrame) -> DataFrame:
    """Without bars that were filled into a gap or carry a quality flag."""
    return bars.where("not coalesce(is_gap_filled, false) and coalesce(dq_flags, 0) = 0")


def from_trades(trades: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, *order: str) -> DataFrame:
    """Bars by symbol and ts: open and close are the first and last price in the given order."""
    t = trades.select(symbol.alias("symbol"), ts.alias("ts"), price.alias("_p"), volume.alias("_v"), F.struct(*order).alias("_o"))
    return t.groupBy("symbol", "ts").agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_o").alias("close"), F.sum("_v").alias("volume")
    ).withColumn("event_time_ns", (F.unix_micros("ts") * 1000).cast("long"))


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Daily bars by return flag, priced by the unit."""
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    made = from_trades(lineitem, F.col("l_returnflag"), F.col("l_shipdate").cast("timestamp"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), *order)
    return made.select("symbol", "event_time_ns", "open", "high", "low", "close", "volume")


def from_events(events: DataFrame) -> DataFrame:
    """Hourly bars by event type."""
    made = from_trades(events, F.col("event_type"), F.date_trunc("hour", F.col("ts").cast("timestamp")), F.col("value"), F.lit(1.0), "ts", "event_id")
    return made.select("symbol", "event_time_ns", "open", "high", "low", "close", "volume")


def sliced(bars: DataFrame, slice_ns: int = 30 * DAY_NS) -> DataFrame:
    """bars with slice, a coarse time bucket. Rows without symbol or time are in no series and left out."""
    return bars.where("symbol is not null and event_time_ns is not null").withColumn("slice", F.coalesce(F.expr(f"event_time_ns div {slice_ns}"), F.lit(0)))


def deduplicate(bars: DataFrame, slice_ns: int = 30 * DAY_NS) -> DataFrame:
    """One bar for each symbol and time, the first by all other columns; adds slice. Rows without either are left out."""
    w = Window.partitionBy("symbol", "slice").orderBy("event_time_ns", *[c for c in ("open", "high", "low", "close", "volume") if c in bars.columns])
    # Without null keys both branches of positions() read one shuffle.
    marked = sliced(bars, slice_ns).withColumn("_before", F.lag("event_time_ns").over(w))
    return marked.where("_before is null or _before <> event_time_ns").drop("_before")


def positions(bars: DataFrame) -> DataFrame:
    """bars of deduplicate() with pos, the row's place in its symbol from 0, and n, the symbol's rows.

    Offsets come from row counts of (symbol, slice), so one symbol is as many tasks as it has slices.
    """
    counts = bars.groupBy("symbol", "slice").agg(F.count("*").alias("_k"))
    by_symbol = Window.partitionBy("symbol")
    offsets = counts.select("symbol", "slice", (F.sum("_k").over(by_symbol.orderBy("slice")) - F.col("_k")).alias("_offset"), F.sum("_k").over(by_symbol).alias("n"))
    row = F.row_number().over(Window.partitionBy("symbol", "slice").orderBy("event_time_ns"))
    return bars.withColumn("_row", row).join(offsets, ["symbol", "slice"]).withColumn("pos", F.col("_offset") + F.col("_row") - 1).drop("_row", "_offset", "slice")


def segment(placed: DataFrame, part: str) -> DataFrame:
    """full, in_sample (the first half of each symbol's rows) or out_of_sample (the last); an odd middle row is in neither."""
    half = F.expr("n div 2")
    kept = {"full": F.lit(True), "in_sample": F.col("pos") < half, "out_of_sample": F.col("pos") >= F.col("n") - half}[part]
    out = placed.where(kept)
    shift = F.when(F.lit(part == "out_of_sample"), F.col("n") - half).otherwise(F.lit(0))
    return out if part == "full" else out.withColumn("pos", F.col("pos") - shift).withColumn("n", half)


def load(bars: DataFrame, days: int = 0, start: str | None = None, end: str | None = None, symbols: list[str] | None = None, part: str = "full") -> DataFrame:
    """Clean bars with pos and n: universe, lookback, dates, one bar a time, segment."""
    bars = universe(bars, symbols) if symbols else bars
    bars = date_range(lookback(bars, days), start, end)
    return segment(positions(deduplicate(bars)), part)


def outcome(placed: DataFrame, least: int = 100) -> DataFrame:
    """One row: pass or insufficient_data, the rows found and a reason."""
    n = F.col("n_rows")
    return placed.agg(F.count("*").alias("n_rows")).select(
        F.when(n < least, "insufficient_data").otherwise("pass").alias("outcome"), "n_rows",
        F.when(n < least, F.concat(F.lit("fewer than "), F.lit(str(least)), F.lit(" bars"))).alias("reason"),
    )
