"""Streams over several files: carried state, late rows, a restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.operators import lifecycle, rolling, transitions
from barlight.plans import scan
from barlight.sources import bars as source
from barlight.streaming import streams


def feed(spark, path, schema, n=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(str(path))


def put(df, path):
    df.coalesce(1).write.mode("append").parquet(str(path))


@pytest.fixture
def writes(spark):
    rows = [(h, t * 10_000_000) for h in ("a", "b") for t in range(12)]
    return spark.createDataFrame(rows, "hash string, ts long")


def test_state_is_carried_over_files_and_a_restart(spark, writes, tmp_path):
    """A window of 30 seconds over writes every ten, in four files; the stream stops after two and goes on."""
    parts = [writes.where((F.col("ts") >= lo * 10_000_000) & (F.col("ts") < (lo + 3) * 10_000_000)) for lo in (0, 3, 6, 9)]
    run = lambda: streams.replayed(streams.accepted_writes(feed(spark, tmp_path / "in", writes.schema), 30_000_000), path=str(tmp_path / "run"))
    for part in parts[:2]:
        put(part, tmp_path / "in")
    first = {(r.hash, r.accepted_at) for r in run().collect()}
    for part in parts[2:]:
        put(part, tmp_path / "in")
    out = run().collect()
    want = {(r.hash, r.accepted_at) for r in lifecycle.accepted_writes(writes, 30_000_000).collect()}
    assert {(r.hash, r.accepted_at) for r in out} == want and len(out) == len(want) and first < want
    assert len({r.batch for r in out}) == 4


def test_reinforcement_over_files_matches_one_batch(spark, tmp_path):
    kinds = list(lifecycle.DELTAS)
    rows = [("n", kinds[i * 7 % 5], "user" if i % 2 else "system", i, i) for i in range(30)]
    events = spark.createDataFrame(rows, "note string, event string, source string, ts long, event_id long")
    for lo in (0, 10, 20):
        put(events.where(F.col("ts").between(lo, lo + 9)), tmp_path / "in")
    states = streams.replayed(streams.reinforced(feed(spark, tmp_path / "in", events.schema)), "update")
    last = states.orderBy(F.desc("batch")).first()
    assert tuple(last)[:5] == tuple(lifecycle.reinforced(events).select("note", "quality", "session_delta", "n_applied", "n_events").first())


def test_late_ticks_are_dropped(spark, tmp_path):
    tick = lambda s, k, p: ("s", s, k, p, 1.0)
    schema = "symbol string, at long, event_id long, price double, volume double"
    # The fourth file's first tick is of a minute that the watermark has passed a file ago; the last ones close the minutes before.
    files = [[tick(0, 1, 10.0), tick(30, 2, 11.0)], [tick(300, 3, 12.0)], [tick(310, 7, 12.0)], [tick(10, 4, 99.0), tick(900, 5, 13.0)], [tick(1500, 6, 14.0)], [tick(1510, 8, 14.0)]]
    for rows in files:
        put(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at")), tmp_path / "in")
    given = feed(spark, tmp_path / "in", spark.read.parquet(str(tmp_path / "in")).schema)
    bars = {r.event_time_ns // 60_000_000_000: (r.open, r.high, r.close, r.volume) for r in streams.replayed(streams.bars(given)).collect()}
    assert bars[0] == (10.0, 11.0, 11.0, 2.0) and bars[5] == (12.0, 12.0, 12.0, 2.0)


def test_features_over_files_and_a_restart_match_one_batch(spark, tmp_path):
    """Symbol b has no bar in the second file, c comes with the third; a bar that is late is dropped."""
    bar = lambda s, i: (s, i * 60_000_000_000, 10.0 + (i * 7 % 5), 12.0 + i % 3, 9.0 - i % 2, 10.0 + (i * 3 % 4), 1.0 + i % 6)
    schema = "symbol string, event_time_ns long, open double, high double, low double, close double, volume double"
    files = [[bar(s, i) for s in "ab" for i in range(15)], [bar("a", i) for i in range(15, 40)], [bar("c", i) for i in range(30)] + [bar("b", i) for i in range(15, 30)], [bar(s, i) for s in "ab" for i in range(40, 60)]]
    run = lambda: streams.features(feed(spark, tmp_path / "in", spark.createDataFrame([], schema).schema), str(tmp_path / "run"), 12, 4)
    for k, rows in enumerate(files):
        put(spark.createDataFrame(rows + [bar("a", 3)] * (k == 3), schema), tmp_path / "in")
        if k == 1:
            run().count()
    names = ["symbol", "event_time_ns", "pos", "ret", "skew", "kurt", "gk_vol", "pk_vol", "volume_ratio", "ret_short", "decoupling"]
    plain = lambda df: {tuple(None if x is None else round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()}
    out = run()
    want = rolling.features(source.load(spark.createDataFrame([r for f in files for r in f], schema)), 12, 4)
    assert plain(out) == plain(want) and out.count() == want.count() and out.select("batch").distinct().count() == 4


def test_signals_over_files_and_a_restart_are_those_of_all_bars(spark, tmp_path):
    """After each batch what plans.scan gives for all bars so far, though only sketches, counts and bounded pools are carried."""
    rng = np.random.default_rng(4)
    schema = "symbol string, event_time_ns long, open double, high double, low double, close double, volume double"
    rows = []
    for s in ("a", "b"):
        close = 100 * np.exp(np.cumsum(rng.standard_t(3, 700) / 300))
        rows += [(s, i * 60_000_000_000, float(c * 0.999), float(c * 1.002), float(c * 0.997), float(c), float(rng.integers(1, 60))) for i, c in enumerate(close)]
    cuts = [lambda r: r[1] < 150 * 60_000_000_000, lambda r: r[0] == "a" and 150 <= r[1] // 60_000_000_000 < 400, lambda r: r[1] // 60_000_000_000 >= 400 or r[0] == "b" and r[1] // 60_000_000_000 >= 150]
    p = scan.ScanParams(long=60, short=10, gap=8, keep=4, least_short=20, least_windows=10, per_symbol=6, total=9, z_moment=1.0, z_volatility=1.0, z_decoupling=1.0, exact=False)
    run = lambda: streams.signals(feed(spark, tmp_path / "in", spark.createDataFrame([], schema).schema), str(tmp_path / "run"), p)
    found, so_far = None, []
    for k, cut in enumerate(cuts):
        own = [r for r in rows if cut(r)]
        so_far += own
        put(spark.createDataFrame(own, schema), tmp_path / "in")
        if k:
            found = run()
            got = {(r.signal_id, round(r.effect_size, 9)) for r in found.where(F.col("batch") == k).collect()}
            want = {(r.signal_id, round(r.effect_size, 9)) for r in scan.scan(spark.createDataFrame(so_far, schema), p).collect()}
            assert got == want and got
    assert len(so_far) == len(rows) and sorted(r.batch for r in found.select("batch").distinct().collect()) == [0, 1, 2]


def test_a_session_ends_and_its_sum_with_it(spark, tmp_path):
    """The stream, event by event and by its timer, as the batch; what is left after the watermark has no sum."""
    minute = 60_000_000
    at = [0, 1, 2, 3, 20, 21, 22, 50, 51]
    rows = [("n", "user_confirm" if i % 2 else "user_reject", "user", t * minute, i) for i, t in enumerate(at)]
    events = spark.createDataFrame(rows, "note string, event string, source string, ts long, event_id long")
    batch = lifecycle.reinforced(events, session_us=10 * minute).first()
    assert tuple(batch) != tuple(lifecycle.reinforced(events).first())
    put(events.where("event_id < 4"), tmp_path / "in")
    put(events.where("event_id >= 4"), tmp_path / "in")
    put(spark.createDataFrame([("other", "user_confirm", "user", 500 * minute, 99)], events.schema), tmp_path / "in")
    states = streams.replayed(streams.reinforced(feed(spark, tmp_path / "in", events.schema), session_us=10 * minute), "update").where("note = 'n'").orderBy("batch", F.desc("session_delta")).collect()
    assert tuple(states[1])[:5] == tuple(batch)
    assert states[-1].session_delta == 0.0 and states[-1].quality == batch.quality and len(states) == 3


@pytest.mark.parametrize("partitions", [1, 9])
def test_sessions_over_spans_of_a_hot_note(spark, partitions):
    rng = np.random.default_rng(partitions)
    kinds = [*lifecycle.DELTAS]
    rows = [("hot" if rng.random() < 0.8 else "cold", kinds[rng.integers(5)], ["system", "user"][rng.integers(2)], int(rng.integers(20_000)), i) for i in range(900)]
    want = {}
    for note in ("hot", "cold"):
        state, last = (500, 0, 0), None
        for _, event, who, ts, _ in sorted((r for r in rows if r[0] == note), key=lambda r: (r[3], r[4])):
            q, s, n = state
            state = transitions.moved((q, 0 if last is not None and ts - last > 40 else s, n), round((700 if who == "system" else 1000) * lifecycle.DELTAS[event]), 500)
            last = ts
        want[note] = (state[0] / 1000, state[1] / 1000, state[2])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = lifecycle.reinforced(spark.createDataFrame(rows, "note string, event string, source string, ts long, event_id long"), session_us=40).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.note: (r.quality, r.session_delta, r.n_applied) for r in got} == want


def test_runs_fall_silent_by_their_own_limits(spark, tmp_path):
    """Limits of 60 and 600 seconds; a run without limits is unknown; states go with their stretches."""
    runs = spark.createDataFrame([("fast", 1.0, 300, 0), ("slow", 60.0, 5000, 2)], "run_id string, heartbeat double, timeout int, retries int")
    event = lambda r, s: (r, s * 1_000_000)
    files = [[event(r, s) for r in ("fast", "slow", "unknown") for s in (0, 30, 60)], [event(r, s) for r in ("fast", "slow") for s in (200, 250)], [event("slow", 3000)], [event("slow", 3001)]]
    for rows in files:
        put(spark.createDataFrame(rows, "run_id string, ts long"), tmp_path / "in")
    out = streams.replayed(streams.silent_runs(feed(spark, tmp_path / "in", spark.createDataFrame([], "run_id string, ts long").schema), runs, "1 second"), path=str(tmp_path / "run"))
    got = sorted((r.run_id, r.started_at // 1_000_000, r.last_event // 1_000_000, r.n_events) for r in out.collect())
    assert got == [("fast", 0, 60, 3), ("fast", 200, 250, 2), ("slow", 0, 250, 5)]
