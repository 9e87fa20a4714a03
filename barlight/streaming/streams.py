"""Streams: bars from ticks, features and signals of bars, duplicate writes, reinforcement, silence, tails."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlight.operators import baseline, ledger, lifecycle, rolling, suppress, transitions
from barlight.plans import scan
from barlight.sources import bars as source
from barlight.sources.scratch import delete, scratch_path


def bars(ticks: DataFrame, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """ticks: symbol, ts, event_id, price, volume. Tumbling bars; ticks later than the watermark are dropped."""
    order = F.struct("ts", "event_id")
    rows = ticks.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return rows.select("symbol", (F.unix_micros("w.start") * 1000).alias("event_time_ns"), "open", "high", "low", "close", "volume")


def first_writes(writes: DataFrame, window: str = "30 seconds") -> DataFrame:
    """The approximate fast form: one write for each hash within the watermark."""
    return writes.withWatermark("ts", window).dropDuplicatesWithinWatermark(["hash"])


SHIFT_US = 100 * 366 * 86_400_000_000  # watermarks start in 1970 and drop what is not later; so event times run a hundred years ahead


class Keyed(StatefulProcessor):
    """A key's value of state, and one event-time timer that ends it: the watermark, not the arrival of more rows, frees the state."""

    fields = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.fields}, timer long")

    def now(self) -> tuple | None:
        """The state's values, its timer last."""
        return tuple(self.state.get()) if self.state.exists() else None

    def put(self, values: tuple, ends_us: int | None) -> None:
        """New values, which the watermark ends when it passes ends_us (None: never)."""
        before = self.now()
        timer = None if ends_us is None else -(-(ends_us + SHIFT_US) // 1000) + 1  # milliseconds
        if before and before[-1] is not None and before[-1] != timer:
            self.handle.deleteTimer(before[-1])
        if timer is not None and (not before or before[-1] != timer):
            self.handle.registerTimer(timer)
        self.state.update((*values, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


class AcceptedWrites(Keyed):
    fields = "last long"

    def __init__(self, window_us: int) -> None:
        self.window_us = window_us

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self.now()
        last = now[0] if now else None
        for ts in sorted(r.ts for r in rows):
            if last is None or ts - last >= self.window_us:
                last = ts
                yield Row(hash=key[0], accepted_at=ts)
        self.put((last,), last + self.window_us)


class Reinforced(Keyed):
    """The session's sum ends with its timer; quality and counts are the note's own and stay."""

    fields = "q long, s long, n long, k long, at long"

    def __init__(self, start: int, cap: int, session_us: int | None) -> None:
        self.start, self.cap, self.session_us = start, cap, session_us

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        q, s, n, k, at, _ = self.now() or (self.start, 0, 0, 0, None, None)
        for ts, _, d in sorted((r.ts, r.event_id, r.d) for r in rows):
            new = self.session_us is not None and at is not None and ts - at > self.session_us
            (q, s, n), k, at = transitions.moved((q, 0 if new else s, n), int(d), self.cap), k + 1, ts
        self.put((q, s, n, k, at), None if self.session_us is None else at + self.session_us)
        yield Row(note=key[0], quality=q / 1000, session_delta=s / 1000, n_applied=n, n_events=k)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        q, _, n, k, at, _ = self.now()
        self.state.update((q, 0, n, k, at, None))
        yield Row(note=key[0], quality=q / 1000, session_delta=0.0, n_applied=n, n_events=k)


class Silent(Keyed):
    fields = "begun long, last long, n long, allowed long"

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self.now()
        begun, last, n, allowed = now[:4] if now else (None, None, 0, None)
        for ts, limit in sorted((r.ts, r.limit_us) for r in rows):
            if last is not None and ts - last > allowed:
                yield Row(run_id=key[0], started_at=begun, last_event=last, n_events=n)
                begun, n = None, 0
            begun, last, n, allowed = ts if begun is None else begun, ts, n + 1, limit
        self.put((begun, last, n, allowed), last + allowed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        begun, last, n, _, _ = self.now()
        self.state.clear()
        yield Row(run_id=key[0], started_at=begun, last_event=last, n_events=n)


def by_event_time(rows: DataFrame, key: str, late: str, processor: Keyed, out: str, mode: str) -> DataFrame:
    """rows: key, ts (microseconds) and what the processor reads. Rows later than the watermark are dropped."""
    timed = rows.where("ts is not null").withColumn("at", F.timestamp_micros(F.col("ts") + SHIFT_US)).withWatermark("at", late)
    return timed.groupBy(key).transformWithState(processor, f"{key} {rows.schema[key].dataType.simpleString()}, {out}", mode, "EventTime")


def accepted_writes(writes: DataFrame, window_us: int, late: str = "1 minute") -> DataFrame:
    """writes: hash, ts (microseconds). The exact rule by keyed state: the last accepted time of each hash, until the watermark has passed its window.

    Batches must bring a hash's writes in order; within a batch they are sorted.
    """
    return by_event_time(writes.select("hash", lifecycle.micros(writes).alias("ts")), "hash", late, AcceptedWrites(window_us), "accepted_at long", "append")


def reinforced(events: DataFrame, start: int = 500, cap: int = 500, session_us: int | None = None, late: str = "1 minute") -> DataFrame:
    """events: note, event, source, ts, event_id. Quality of each note after each batch, by the batch operator's rule in thousandths; a row more where a session ends by the watermark."""
    known = events.withColumn("d", lifecycle.delta(F.col("event"), F.col("source"))).where("d is not null").select("note", lifecycle.micros(events).alias("ts"), "event_id", "d")
    return by_event_time(known, "note", late, Reinforced(start, cap, session_us), "quality double, session_delta double, n_applied long, n_events long", "update")


def silent_runs(events: DataFrame, runs: DataFrame, late: str = "1 minute") -> DataFrame:
    """events: a stream of run_id, ts; runs: a table of run_id, heartbeat, timeout, retries (those of the run's agent that may take longest).

    Each stretch of activity of a run, given out once the run has been silent for longer than its own limit (operators.ledger.stale_after); events of unknown runs are left out.
    A run's state goes with its stretch.
    """
    limit = (ledger.stale_after(F.col("heartbeat"), F.col("timeout"), F.col("retries")) * 1_000_000).cast("long")
    known = events.select("run_id", lifecycle.micros(events).alias("ts")).join(runs.select("run_id", limit.alias("limit_us")), "run_id")
    return by_event_time(known, "run_id", late, Silent(), "started_at long, last_event long, n_events long", "append")


def silences(events: DataFrame, gap: str, late: str = "1 minute") -> DataFrame:
    """events: run_id, ts. Each stretch of activity of a run, given out once the gap has passed without another event."""
    return events.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_event")).select(
        "run_id", F.col("w.start").alias("started_at"), "last_event", "n_events")


def tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as they are added to a folder; the query's checkpoint remembers the place."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


COLUMNS = ["symbol", "event_time_ns", "open", "high", "low", "close", "volume"]


def _advanced(batch: DataFrame, number: int, path: str, long: int, short: int) -> DataFrame:
    """Features of a batch's new bars, written to path/out; the last long + 1 bars of each symbol stay in path/rows for the next batch."""
    spark, batch = batch.sparkSession, batch.select(*COLUMNS)
    schema = ", ".join(f"{c} {t}" for c, t in batch.dtypes) + ", pos long, n long, seen long"
    kept = lambda k: spark.read.schema(schema).parquet(f"{path}/rows/batch={k}")
    old = kept(number - 1).where(f"pos >= n - {long + 1}") if number else spark.createDataFrame([], schema)
    last = old.groupBy("symbol").agg(F.max("event_time_ns").alias("_at"), F.max("n").alias("_seen"))
    fresh = batch.join(last, "symbol", "left").where("_at is null or event_time_ns > _at").drop("_at")
    placed = source.positions(source.deduplicate(fresh)).withColumn("pos", F.col("pos") + F.coalesce("_seen", F.lit(0)))
    both = old.select(*COLUMNS, "pos").unionByName(placed.select(*COLUMNS, "pos"))
    sizes = both.groupBy("symbol").agg((F.max("pos") + 1).alias("n")).join(last.select("symbol", "_seen"), "symbol", "left")
    rows = both.join(sizes, "symbol").select(*COLUMNS, "pos", "n", F.coalesce("_seen", F.lit(0)).cast("long").alias("seen"))
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    seen = kept(number).groupBy("symbol").agg(F.max("seen").alias("_seen"))
    made = rolling.features(kept(number).drop("seen"), long, short).join(seen, "symbol").where("pos >= _seen").drop("_seen", "n")
    made.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    if number > 1:
        delete(spark, f"{path}/rows/batch={number - 2}")
    return spark.read.schema(made.schema).parquet(f"{path}/out/batch={number}")


def features(bars: DataFrame, path: str | None = None, long: int = 1440, short: int = 60) -> DataFrame:
    """bars: a stream of bars, each symbol's in order of time. rolling.features of every bar, by batch, as over all bars at once.

    A batch is joined to the last long + 1 bars that each symbol has had (in path/rows, with their places). A bar that is not later
    than those is dropped. With the path of an earlier run it goes on from there; a batch that is run again replaces its own folders.
    """
    path = path or scratch_path(bars.sparkSession, "features")
    bars.writeStream.foreachBatch(lambda batch, number: _advanced(batch, number, path, long, short) and None).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return bars.sparkSession.read.parquet(f"{path}/out")


def _pool(rows: DataFrame, most: int) -> DataFrame:
    """Of each symbol and feature the `most` largest and smallest rows, each row once.

    Wherever the median will lie, those that deviate most from it are among these; so no other row can ever become a signal."""
    names = ["skew", "kurt", "gk_vol", "decoupling"]
    long = rows.select(F.struct(*rows.columns).alias("row"), F.posexplode(F.array(*[F.when(scan.valid(c), F.col(c)) for c in names])).alias("c", "x")).where("x is not null")
    by = lambda order: F.row_number().over(Window.partitionBy("row.symbol", "c").orderBy(order, F.desc("row.pos")))
    ends = [long.withColumn("_n", by(order)).where(F.col("_n") <= most) for order in (F.desc("x"), F.asc("x"))]
    return ends[0].unionByName(ends[1]).select("row.*").dropDuplicates(["symbol", "pos"])


def signals(bars: DataFrame, path: str | None = None, p: scan.ScanParams = scan.ScanParams(exact=False)) -> DataFrame:
    """bars: a stream of bars, each symbol's in order of time. After each batch the signals of all bars so far, as plans.scan.scan gives with exact=False; column batch.

    Beside the bars that windows reach back to, what is carried from batch to batch is bounded for each symbol: counts and a mergeable quantile sketch of each feature (path/base),
    and the rows that can still be signals (path/pool; operators.suppress.prune_limit at each end of each feature). With the path of an earlier run it
    goes on from there; a batch that is run again replaces its own folders.
    """
    spark, path = bars.sparkSession, path or scratch_path(bars.sparkSession, "signals")
    names = ["skew", "kurt", "gk_vol", "decoupling"]
    most = suppress.prune_limit(p.keep, p.gap)

    def step(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        made = _advanced(batch, number, path, p.long, p.short).select("symbol", "event_time_ns", "pos", *names)
        fresh = made.groupBy("symbol").agg(
            F.count("*").alias("n_rows"), *[F.count_if(scan.valid(c)).alias(f"valid_{c}") for c in names], *[F.kll_sketch_agg_double(F.when(scan.valid(c), F.col(c)), F.lit(baseline.SKETCH_K)).alias(f"sketch_{c}") for c in names])
        old = lambda kind, like: here.read.schema(like.schema).parquet(f"{path}/{kind}/batch={number - 1}") if number else here.createDataFrame([], like.schema)
        base = old("base", fresh).unionByName(fresh).groupBy("symbol").agg(
            F.sum("n_rows").alias("n_rows"), *[F.sum(f"valid_{c}").alias(f"valid_{c}") for c in names], *[F.kll_merge_agg_double(f"sketch_{c}", F.lit(baseline.SKETCH_K)).alias(f"sketch_{c}") for c in names])
        base.write.mode("overwrite").parquet(f"{path}/base/batch={number}")
        _pool(old("pool", made).unionByName(made), most).write.mode("overwrite").parquet(f"{path}/pool/batch={number}")
        base = here.read.schema(base.schema).parquet(f"{path}/base/batch={number}")
        middles = {c: baseline.of_sketch(F.col(f"sketch_{c}")) for c in names}
        found = base.select("symbol", F.col("n_rows").alias("n"), *[f"valid_{c}" for c in names], *[x.alias(f"{what}_{c}") for c, pair in middles.items() for what, x in zip(("med", "mad"), pair)])
        rows = baseline.against(here.read.schema(made.schema).parquet(f"{path}/pool/batch={number}"), found, names)
        if (base.agg(F.sum("n_rows")).first()[0] or 0) < p.least_total:
            rows = rows.where("false")
        suppress.top(scan.suppressed(rows, p, list(scan.SCANNERS)), p.per_symbol, p.total).write.mode("overwrite").parquet(f"{path}/signals/batch={number}")
        for kind in ("base", "pool"):
            if number > 1:
                delete(here, f"{path}/{kind}/batch={number - 2}")

    bars.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/signals")


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def replayed(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over everything that is there now; what it gave out, by batch. A batch that is run again replaces its own folder.

    With the path of an earlier run it goes on from there: its state and its place in the input are in that folder."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():  # state larger than memory; keyed states need it
        spark.conf.set(k, v)
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch long").parquet(f"{path}/out")
