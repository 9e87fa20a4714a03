"""Order-dependent rules over spans against plain folds, with keys that hold most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.operators import lifecycle, transitions

DELTAS = sorted(set(lifecycle.DELTAS_ALL))


@pytest.mark.parametrize("cap", [500, 100])
def test_every_start_leads_where_a_known_one_does(cap):
    rng = random.Random(cap)
    deltas = np.array([rng.choice(DELTAS) for _ in range(300)])
    every = transitions.Every(cap, transitions.step_of(DELTAS))
    fresh = np.array([i % 90 == 89 for i in range(300)])
    every.apply(deltas[:130], fresh[:130])
    every.apply(deltas[130:], fresh[130:])
    for _ in range(200):
        state = (10 * rng.randrange(101), 5 * rng.randrange(-cap // 5, cap // 5 + 1), rng.randrange(9))
        known = transitions.Known(state, cap)
        known.apply(deltas, fresh)
        q, s, n = every.table()[every.place(state)].tolist()
        assert (q, s, n + state[2]) == known.state


def fold_notes(rows):
    out = {}
    for note in {r[0] for r in rows}:
        own = sorted((r[3], r[4], round((700 if r[2] == "system" else 1000) * lifecycle.DELTAS[r[1]])) for r in rows if r[0] == note and r[1] in lifecycle.DELTAS)
        state = (500, 0, 0)
        for _, _, d in own:
            state = transitions.moved(state, d, 500)
        out[note] = (state[0] / 1000, state[1] / 1000, state[2], len(own))
    return out


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_a_note_with_most_events_is_many_tasks(spark, partitions):
    rng = random.Random(partitions)
    kinds = [*lifecycle.DELTAS, "unknown"]
    rows = [(rng.choice([None, "hot", "hot", "hot", *"abcdef"]), rng.choice(kinds), rng.choice(["system", "user", None]), rng.randrange(2000), rng.randrange(5)) for _ in range(3000)]
    events = spark.createDataFrame(rows, "note string, event string, source string, ts long, event_id long").repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        dealt = events.where("note = 'hot'").repartitionByRange("note", "ts", "event_id").select(F.spark_partition_id().alias("p")).distinct().count()
        assert dealt > partitions / 2
        got = {r.note: (r.quality, r.session_delta, r.n_applied, r.n_events) for r in lifecycle.reinforced(events).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == fold_notes(rows)


def fold_writes(rows, window):
    out = set()
    for h in {r[0] for r in rows}:
        own, last = [t for g, t in rows if g == h], None
        for t in sorted(t for t in own if t is not None):
            if last is None or t - last >= window:
                last = t
                out.add((h, len(own), t))
    return out


@pytest.mark.parametrize(("window", "windows", "width"), [(10, 1, 3000), (10, 2, 3000), (7, 64, 900), (30, 4, 200), (1, 3, 500), (500, 2, 300)])
def test_writes_of_a_hot_hash_over_spans(spark, window, windows, width):
    rng = random.Random(width)
    rows = [(rng.choice(["hot", "hot", None, "a", "b"]), rng.choice([None, *[rng.randrange(-width, width) for _ in range(20)]])) for _ in range(1500)]
    got = lifecycle.accepted_writes(spark.createDataFrame(rows, "hash string, ts long").repartition(3), window, windows).collect()
    assert {tuple(r) for r in got} == fold_writes(rows, window) and len(got) == len({tuple(r) for r in got})


def test_steps_of_a_span():
    rng = np.random.default_rng(0)
    for _ in range(200):
        ts, window = np.unique(rng.integers(0, 200, 40)), int(rng.integers(1, 60))
        upto, then = transitions.release(ts, window)
        for free_at in range(-5, 210):
            kept = transitions.accepted_from(ts, window, free_at)
            i = int(np.searchsorted(upto, free_at))
            assert (i == len(upto)) == (len(kept) == 0) and (len(kept) == 0 or then[i] == kept[-1] + window)


def test_no_window_is_refused(spark):
    with pytest.raises(ValueError):
        lifecycle.accepted_writes(spark.createDataFrame([], "hash string, ts long"), 0)
