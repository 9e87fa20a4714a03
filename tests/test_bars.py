"""Bars: edge cases, brute-force twins, plan shape."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.operators import moments, quality, rolling, stats, suppress
from barlight.plans import scan as plan
from barlight.sources import bars as source

MINUTE = 60_000_000_000


def series(spark, n, symbol="S", seed=0, **odd):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.standard_t(4, n) / 200))
    rows = [(symbol, i * MINUTE, float(c * 0.999), float(c * 1.002), float(c * 0.997), float(c), float(rng.integers(1, 100))) for i, c in enumerate(close)]
    for i, change in odd.items():
        rows[int(i[1:])] = change(rows[int(i[1:])])
    return spark.createDataFrame(rows, source.BAR_SCHEMA)


def brute_moments(x, length):
    out = []
    for i in range(len(x)):
        w = x[max(0, i - length + 1) : i + 1]
        if len(w) < length or any(v is None for v in w):
            out.append((None, None))
            continue
        m = sum(w) / length
        v, c3, c4 = (sum((a - m) ** k for a in w) / length for k in (2, 3, 4))
        out.append((c3 / v**1.5, c4 / v**2 - 3))
    return out


@pytest.mark.parametrize("rows", [64, 1 << 16])
def test_rolling_moments(spark, rows):
    bars = series(spark, 300)
    got = rolling.features(source.load(bars), 50, 6, rows).orderBy("pos").collect()
    ret = [None] + [math.log(b.close) - math.log(a.close) for a, b in zip(*(lambda r: (r, r[1:]))(bars.orderBy("event_time_ns").collect()))]
    for r, (s, k) in zip(got, brute_moments(ret, 50)):
        assert (r.skew is None) == (s is None) and (s is None or (abs(r.skew - s) < 1e-9 and abs(r.kurt - k) < 1e-9))
    assert [r.pos for r in got] == list(range(300))


def exact_shape(x, length):
    """Skewness and kurtosis of each window in rational numbers; None where nothing varies."""
    from fractions import Fraction

    out = []
    for i in range(length - 1, len(x)):
        w = [Fraction(v) for v in x[i - length + 1 : i + 1]]
        m = sum(w) / length
        v, c3, c4 = (sum((a - m) ** k for a in w) / length for k in (2, 3, 4))
        out.append(None if v == 0 else (float(c3) / float(v) ** 1.5, float(c4 / v**2) - 3))
    return out


@pytest.mark.parametrize("kind", ["flat", "spiked", "tiny", "steps"])
def test_moments_of_windows_are_exact_to_nine_digits(kind):
    """Nothing that has left a window is felt in it, and what does not vary has no shape."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1e-4, 400)
    if kind == "flat":
        x[100:250] = 0.0
    elif kind == "spiked":
        x[[60, 61, 300]] = 0.3, -2.3, 10.0
    elif kind == "tiny":
        x = 5e-4 + x * 1e-9
    else:
        x = np.repeat(rng.normal(0, 1e-3, 10), 40)
    for length in (7, 24, 60):
        skew, kurt, varies = moments.shape(moments.windows(x, length))
        want = exact_shape(x.tolist(), length)
        assert len(want) == len(skew)
        for s, k, v, w in zip(skew, kurt, varies, want):
            assert v == (w is not None)
            # Of values that share their first digits no arithmetic in doubles keeps more than what is left of them.
            allowed = 1e-9 if kind != "tiny" else 1e-3
            assert w is None or abs(s - w[0]) <= allowed * max(1, abs(w[0])) and abs(k - w[1]) <= allowed * max(1, abs(w[1]))


def test_sums_of_windows():
    x = np.random.default_rng(1).integers(-9, 9, 100)
    for length in (1, 3, 7, 100, 150):
        assert moments.sums(x, length).tolist() == [x[max(0, i - length + 1) : i + 1].sum() for i in range(100)]


def test_a_halt_is_no_anomaly(spark):
    """Minutes that stand still after returns of 5e-4, then a jump: A1 reports the jump, and no window that stands still as a whole."""
    rng = np.random.default_rng(9)
    ret = rng.choice([-5e-4, 5e-4], 3000)
    ret[1000:2000], ret[2500] = 0.0, 0.05
    close = 100 * np.exp(np.cumsum(ret))
    close[1000:2000] = close[999]
    bars = spark.createDataFrame([("S", i * MINUTE, c, c, c, c, 10.0) for i, c in enumerate(close.tolist())], source.BAR_SCHEMA)
    rows = {r.pos: r for r in rolling.features(source.load(bars), 240, 60).collect()}
    assert all(rows[p].skew is None and rows[p].kurt is None for p in range(1239, 2000)) and all(abs(rows[p].kurt) < 250 for p in rows if rows[p].kurt is not None)
    found = plan.signals(source.load(bars), plan.ScanParams(long=240), ["A1"]).collect()
    assert not any(1239 <= r.pos < 2000 for r in found) and any(2500 <= r.pos < 2740 for r in found)


def test_zero_and_null_prices_make_invalid_windows(spark):
    bars = series(spark, 120, _60=lambda r: (*r[:5], 0.0, r[6]), _90=lambda r: (*r[:5], None, r[6]))
    got = {r.pos: r for r in rolling.features(source.load(bars), 20, 6).collect()}
    assert all(got[p].skew is None for p in range(60, 81)) and got[59].skew is not None and got[82].skew is not None
    assert plan.signals(source.load(bars), plan.ScanParams(long=20, short=6, gap=6, least_short=10, least_windows=10)).count() >= 0


def test_segments_of_an_odd_series(spark):
    placed = source.load(series(spark, 101))
    first, last = ({r.event_time_ns // MINUTE for r in source.segment(placed, s).collect()} for s in ("in_sample", "out_of_sample"))
    assert first == set(range(50)) and last == set(range(51, 101))
    assert sorted(r.pos for r in source.segment(placed, "out_of_sample").collect()) == list(range(50))


def test_duplicate_times_keep_the_lowest_bar(spark):
    rows = [("S", 0, 2.0, 2.0, 2.0, 2.0, 1.0), ("S", 0, 1.0, 9.0, 1.0, 1.0, 1.0), ("S", MINUTE, 3.0, 3.0, 3.0, 3.0, 1.0)]
    assert [r.open for r in source.deduplicate(spark.createDataFrame(rows, source.BAR_SCHEMA)).orderBy("event_time_ns").collect()] == [1.0, 3.0]


def brute_suppress(rows, keep, gap):
    kept = []
    for strength, pos in sorted(rows, reverse=True):
        if all(abs(pos - p) >= gap for p in kept):
            kept.append(pos)
            if len(kept) == keep:
                break
    return set(kept)


@pytest.mark.parametrize("seed", range(4))
def test_suppression_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {g: [(float(rng.integers(0, 50)) / 10, int(p)) for p in rng.choice(1500, 400, replace=False)] for g in ("a", "b", "c")}
    df = spark.createDataFrame([(g, s, p) for g, rows in groups.items() for s, p in rows], "symbol string, strength double, pos long")
    got = suppress.suppress(df, ["symbol"], keep=7, gap=23).collect()
    for g, rows in groups.items():
        assert {r.pos for r in got if r.symbol == g} == brute_suppress(rows, 7, 23)


def test_suppression_distance(spark):
    df = spark.createDataFrame([("s", 3.0, 100), ("s", 2.0, 159), ("s", 1.0, 160), ("s", 1.0, 40)], "symbol string, strength double, pos long")
    assert {r.pos for r in suppress.suppress(df, ["symbol"]).collect()} == {100, 160, 40}
    assert suppress.prune_limit(10, 60) == 1072


def test_scan_properties(spark):
    p = plan.ScanParams(long=60, short=12, gap=12, least_short=30, least_windows=30)
    bars = series(spark, 600).unionByName(series(spark, 601, "T", 1)).cache()
    found = plan.scan(bars, p).collect()
    assert 0 < len(found) <= 50 and all(sum(r.symbol == s for r in found) <= 10 for s in "ST")
    places = {}
    for r in found:
        places.setdefault((r.symbol, r.scanner), []).append(r.pos)
    assert all(abs(a - b) >= 12 for v in places.values() for i, a in enumerate(v) for b in v[:i])
    scaled = bars.select("symbol", "event_time_ns", *[(F.col(c) * 4).alias(c) for c in ("open", "high", "low", "close")], "volume")
    assert [r.signal_id for r in plan.scan(scaled, p).collect()] == [r.signal_id for r in found]


def test_too_few_bars_give_an_outcome(spark):
    bars = series(spark, 50)
    assert plan.scan(bars).count() == 0
    assert source.outcome(source.load(bars)).first().outcome == "insufficient_data"
    assert plan.report(plan.scan(bars)).first().status == "warning"


def test_bad_dates_raise(spark):
    with pytest.raises(ValueError):
        source.date_range(series(spark, 3), "yesterday")


def test_files_of_many_symbols(spark, tmp_path):
    series(spark, 30, "AAA").drop("symbol").write.parquet(str(tmp_path / "data/AAA/year=2024/month=1"))
    series(spark, 20, "BBB").drop("symbol", "volume").write.parquet(str(tmp_path / "data/BBB/year=2024/month=2"))
    (tmp_path / "data/AAA/_metadata.json").write_text('{"san": "X", "symbol": "AAA", "schema_version": "1", "nen": "snappy", "nguon": "ws", "tao_luc": "2024-01-01T00:00:00"}')
    got = source.read(spark, str(tmp_path / "data"))
    assert {(r.symbol, r["count"]) for r in got.groupBy("symbol").count().collect()} == {("AAA", 30), ("BBB", 20)}
    assert got.where("symbol = 'BBB' and volume is not null").count() == 0
    assert source.read(spark, str(tmp_path / "data"), ["AAA", "ZZZ"]).count() == 30
    assert [r.symbol for r in source.registry(got).orderBy("symbol").collect()] == ["AAA", "BBB"] and source.registry(got.where("false")).count() == 5
    assert source.metadata(spark, str(tmp_path / "data")).first().venue == "X"


def test_plan_shape(spark, small, tmp_path):
    bars = series(spark, 200).cache()
    bars.write.parquet(str(tmp_path / "bars"))
    read = spark.read.parquet(str(tmp_path / "bars"))
    text = source.date_range(read, "1970-01-01T00:10:00Z").select("symbol", "close")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_time_ns), GreaterThanOrEqual(event_time_ns" in text and "ReadSchema: struct<symbol:string,event_time_ns:bigint,close:double>" in text
    made = plan.signals(source.load(read), plan.ScanParams(long=20, short=6))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in made and "SinglePartition" not in made and "WindowGroupLimit" in made


@pytest.mark.parametrize("kind", ["ties", "few", "spread", "signs", "zeros", "none"])
def test_exact_medians(spark, kind):
    from barlight.operators import baseline

    rng = np.random.default_rng(7)
    values = {"ties": [1.0] * 700 + [2.0] * 700 + [3.0] * 5, "few": [5.0, 1.0], "spread": rng.normal(size=4001).tolist(), "signs": (rng.normal(size=2000) ** 9).tolist() + [None] * 7, "zeros": [0.0] * 600 + rng.normal(size=500).tolist(), "none": [None] * 3}[kind]
    df = spark.createDataFrame([("s", v) for v in values], "symbol string, x double")
    row = baseline.baselines(df, {"x": F.col("x").isNotNull()}).first()
    known = np.array([v for v in values if v is not None])
    if not len(known):
        assert row.med_x is None and row.mad_x is None
    else:
        assert row.med_x == np.median(known) and row.mad_x == np.median(np.abs(known - np.median(known))) and row.valid_x == len(known) and row.n_rows == len(values)


def test_extensions_are_the_same_over_slices_and_buckets(spark):
    """Bars with holes and nulls over many slices, against plain Python."""
    day = 86_400_000_000_000
    times = [i * 7 * day + (i % 4 == 0) * day for i in range(60) if i % 9]
    rows = [("s", t, 1.0 + (i * 5 % 7), None if i % 11 in (3, 4, 5) or i < 2 else float(i * 3 % 8), 1.0 + i % 5) for i, t in enumerate(times)] + [("none", t, 1.0, None, 1.0) for t in times[:7]]
    df = spark.createDataFrame(rows + [(None, 1, 1.0, 1.0, 1.0), ("s", None, 1.0, 1.0, 1.0)], "symbol string, event_time_ns long, close double, x double, volume double")
    found = {(r.gap_from, r.gap_to) for r in quality.breaks(df, 8 * day).collect()}
    assert found == {(a, b) for a, b in zip(times, times[1:]) if b - a > 8 * day} and found
    xs = [r[3] for r in rows if r[0] == "s"]
    runs = max(len(run) for run in "".join("0" if x is None else "1" for x in xs).split("1"))
    got = {r.symbol: (r.n_rows, r.n_valid, r.longest_null_run) for r in quality.coverage(df, "x", 10, rows=4).collect()}
    assert got == {"s": (len(xs), len(xs) - xs.count(None), runs), "none": (7, 0, 7)}
    base = {r.event_time_ns: (r.base_n, r.base_mean) for r in quality.causal_baseline(df.where("symbol = 's'"), "x", 20 * day, 5 * day).collect()}
    for t in times:
        inside = [x for u, x in zip(times, xs) if t - 25 * day <= u < t - 5 * day and x is not None]
        assert base[t][0] == len(inside) and (base[t][1] is None) == (not inside) and (not inside or abs(base[t][1] - sum(inside) / len(inside)) < 1e-9)
    c = np.array([r[2] for r in rows if r[0] == "s"])
    c = c - c.mean()
    cov = {r.lag: r.cov for r in stats.autocovariances(df.where("symbol = 's'"), "close", 3, rows=8).collect()}
    assert np.allclose([cov[k] for k in range(4)], [(c[k:] * c[: len(c) - k]).sum() / len(c) for k in range(4)])


def test_baseline_by_hours(spark):
    """Edges within hours, ties, nulls, hours without bars and times before 1970, against plain Python; narrow and odd widths too."""
    rng, hour = np.random.default_rng(3), 3_600_000_000_000
    times = sorted(int(t) for t in rng.integers(-30 * hour, 90 * hour, 400)) + [5 * hour, 5 * hour, 6 * hour, 7 * hour]
    rows = [("s", t, None if i % 13 == 0 else 1e6 + float(rng.normal()), 1) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows + [("t", 0, 2.0, 1), (None, 1, 1.0, 1), ("s", None, 1.0, 1)], "symbol string, event_time_ns long, x double, _t int")
    for width, embargo in ((7 * hour, 0), (7 * hour, hour + 17), (hour, 3), (2 * hour, 2 * hour), (hour * 3 // 2, 11)):
        got = quality.causal_baseline(df, "x", width, embargo).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            inside = [x for s, t, x, _ in rows if s == r.symbol and r.event_time_ns - width - embargo <= t < r.event_time_ns - embargo and x is not None]
            assert r.base_n == len(inside) and (r.base_sd is None) == (not inside)
            assert not inside or (abs(r.base_mean - np.mean(inside)) < 1e-6 and abs(r.base_sd - np.std(inside)) < 1e-6)


def test_baseline_frame_is_as_long_as_the_window_has_hours(spark):
    df = series(spark, 300)
    plan_ = quality.causal_baseline(df, "close", 168 * 3_600_000_000_000, 0)._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, -167, -1" in plan_.replace("specifiedwindowframe(", "") and "SinglePartition" not in plan_ and "Python" not in plan_


def test_sidecars_are_written_and_read_by_tasks(spark, tmp_path):
    from barlight.sources import sidecars

    root = str(tmp_path / "side")
    rows = [(f"S{i}", "X" if i % 2 else None, "v1") for i in range(23)] + [("ünï 1", "Y", "v2"), (None, "Z", "v3"), ("", "Z", "v3")]
    sidecars.write(spark.createDataFrame(rows, "symbol string, venue string, schema_version string"), root)
    (tmp_path / "side/none").mkdir()
    (tmp_path / "side/torn").mkdir()
    (tmp_path / "side/torn/_metadata.json").write_text('{"san": "X')
    got = sidecars.read(spark, root, per_task=5)
    assert got.rdd.getNumPartitions() == 6
    assert {(r.folder, r.venue, r.schema_version) for r in got.collect()} == {r for r in rows if r[0]}
    assert sidecars.read(spark, f"file:{root}").count() == 24
    spark.conf.set(sidecars.PUSHDOWN, "true")
    try:
        few = sidecars.read(spark, root, per_task=1).where("folder in ('S1', 'S2', 'torn') and folder <> 'S2'")
        assert few.rdd.getNumPartitions() == 3 and [r.folder for r in few.collect()] == ["S1"]
    finally:
        spark.conf.unset(sidecars.PUSHDOWN)
    bars = spark.createDataFrame([("S1", 1), ("none", 2), (None, 3)], "symbol string, n int")
    assert {(r.symbol, r.n, r.venue) for r in sidecars.stamped(bars, got).collect()} == {("S1", 1, "X"), ("none", 2, None), (None, 3, None)}


def test_effective_observations(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400), rng.normal(size=400)
    rows = [(i, float(a[i]), float(a[i]), float(b[i]), None) for i in range(400)]
    r = stats.effective_observations(spark.createDataFrame(rows, "event_time_ns long, a double, b double, c double, d double"), ["a", "b", "c"]).first()
    m = np.corrcoef([a, a, b])
    assert r.lags == int(4 * 4 ** (2 / 9)) and abs(r.participation - np.trace(m) ** 2 / (m**2).sum()) < 1e-9 and abs(r.n_effective - r.n_time * r.participation / 3) < 1e-9
    assert stats.effective_observations(spark.createDataFrame([], "event_time_ns long, a double, b double"), ["a", "b"]).first().n_effective is None
    found = stats.tested(spark.createDataFrame([(1, 9.0), (2, 0.1)], "id long, z double"), "z", spark.createDataFrame([(50.0,)], "n_effective double"))
    assert {(x.id, x.rejected) for x in found.collect()} == {(1, True), (2, False)}


def test_hit_rates_and_specs_of_clusters(spark):
    made = stats.sign_hit_rate(spark.createDataFrame([("a", 1.5, 0.1), ("a", -1.0, 0.1), ("a", 1.0, 0.0), ("a", 1.0, None), ("b", -2.0, -9.0)], "g string, x double, y double"), "g", F.col("x"), F.col("y"))
    assert {(r.g, r.n, round(r.hit_rate, 6)) for r in made.collect()} == {("a", 3, 0.333333), ("b", 1, 1.0)}
    signals = spark.createDataFrame([(1, ["b", "a"], 2.0, 3), (2, ["a"], -5.0, 4), (3, None, 1.0, 1)], "signal_id long, columns array<string>, effect_size double, tests long")
    of = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "signal_id long, cluster long")
    assert {(r.cluster, tuple(r.columns), r.sign, r.n_signals, r.tests_independent) for r in stats.cluster_specs(signals, of).collect()} == {(1, ("a", "b"), -1, 2, 7), (3, (), 1, 1, 1)}
