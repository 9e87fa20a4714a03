"""Gaps, coverage, causal baselines and block statistics of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.operators.rolling import by_bucket, features, with_halo
from barlight.sources import bars as source


def previous(bars: DataFrame, *columns: str) -> DataFrame:
    """bars with previous, these columns of the symbol's bar before as a struct (null for its first).

    Slices of time are the tasks: the first bar of a slice takes the last one of the symbol's slice before, of which there is a row each."""
    known, value = source.sliced(bars), F.struct(*columns)
    ends = known.groupBy("symbol", "slice").agg(F.max_by(value, "event_time_ns").alias("_end"))
    before = ends.select("symbol", "slice", F.lag("_end").over(Window.partitionBy("symbol").orderBy("slice")).alias("_end"))
    lag = F.lag(value).over(Window.partitionBy("symbol", "slice").orderBy("event_time_ns"))
    return known.join(before, ["symbol", "slice"]).withColumn("previous", F.coalesce(lag, F.col("_end"))).drop("slice", "_end")


def gap_segments(placed: DataFrame, expected_ns: int, rows: int = 1 << 16) -> DataFrame:
    """placed: bars with pos and n (sources.bars.positions). segment: how many gaps longer than expected lie before the bar; start: pos of the segment's first bar.

    Gaps are counted by buckets of rows, whose sums give each bucket its first segment: one symbol is many tasks."""
    w = by_bucket()
    gap = F.coalesce(F.col("event_time_ns") - F.lag("event_time_ns").over(w) > expected_ns, F.lit(False))
    marked = with_halo(placed, 1, rows).withColumn("_gap", gap).where("own")
    of_symbol = Window.partitionBy("symbol").orderBy("bucket")  # a row a bucket
    sums = marked.groupBy("symbol", "bucket").agg(F.count_if("_gap").alias("_k"), F.max(F.when(F.col("_gap"), F.col("pos"))).alias("_last"))
    heads = sums.select("symbol", "bucket", (F.sum("_k").over(of_symbol) - F.col("_k")).alias("_before"), F.last("_last", True).over(of_symbol.rowsBetween(Window.unboundedPreceding, -1)).alias("_start"))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.last(F.when(F.col("_gap"), F.col("pos")), True).over(running), F.col("_start"), F.lit(0))
    joined = marked.join(heads, ["symbol", "bucket"])
    out = joined.withColumns({"segment": F.col("_before") + F.sum(F.col("_gap").cast("long")).over(running), "start": start.cast("long")})
    return out.select(*placed.columns, "segment", "start")


def features_by_segment(placed: DataFrame, expected_ns: int, long: int = 1440, short: int = 60, rows: int = 1 << 16) -> DataFrame:
    """rolling.features with windows that end at gaps: each segment of a symbol is a series of its own; pos and n are the symbol's."""
    cut = gap_segments(placed, expected_ns, rows)
    sizes = cut.groupBy("symbol", "segment").agg(F.count("*").alias("_size"))
    own = cut.join(sizes, ["symbol", "segment"]).select(
        F.struct("symbol", "segment", "start", "n").alias("symbol"), "event_time_ns", (F.col("pos") - F.col("start")).alias("pos"), F.col("_size").alias("n"), "open", "high", "low", "close", "volume")
    made = features(own, long, short, rows)
    rest = [c for c in made.columns if c not in ("symbol", "event_time_ns", "pos", "n")]
    return made.select("symbol.symbol", "event_time_ns", (F.col("pos") + F.col("symbol.start")).alias("pos"), F.col("symbol.n").alias("n"), *rest)


def breaks(bars: DataFrame, expected_ns: int) -> DataFrame:
    """symbol, gap_from, gap_to: bars further apart than expected."""
    pairs = previous(bars.select("symbol", "event_time_ns"), "event_time_ns").select("symbol", F.col("previous.event_time_ns").alias("gap_from"), F.col("event_time_ns").alias("gap_to"))
    return pairs.where(F.col("gap_to") - F.col("gap_from") > expected_ns)


def manifest_errors(manifest: DataFrame, found: DataFrame, bin_ns: int = 30 * source.DAY_NS) -> DataFrame:
    """Gaps of the manifest that no break overlaps. Repeated gaps are errors each.

    Intervals are dealt out by the bins of time that they touch, so one symbol is as many tasks as it has bins; two that overlap share the bin in which
    the later one begins. In a bin both lists are merged in time order: an interval meets an earlier one if the latest end so far passes its start,
    and a later one if the earliest start that follows comes before its end. No pair of intervals is built. A gap without an end touches no bin and is an error.
    """
    columns = ["symbol", "gap_from", "gap_to"]
    asked = manifest.select(*columns).groupBy(*columns).agg(F.count("*").alias("_n"))
    bins = F.sequence(F.floor(F.col("gap_from") / F.lit(bin_ns)), F.floor(F.greatest("gap_from", F.col("gap_to") - 1) / F.lit(bin_ns)))
    both = asked.select(*columns, F.lit(0).alias("_found")).unionByName(found.select(*columns, F.lit(1).alias("_found"))).where("gap_from is not null and gap_to is not null")
    dealt = both.withColumn("_bin", F.explode(bins))
    of = Window.partitionBy("symbol", "_bin")
    forth, back = of.orderBy("gap_from", F.desc("_found"), "gap_to"), of.orderBy(F.desc("gap_from"), "_found", F.desc("gap_to"))
    end = F.max(F.when(F.col("_found") == 1, F.col("gap_to"))).over(forth.rowsBetween(Window.unboundedPreceding, -1))
    start = F.min(F.when(F.col("_found") == 1, F.col("gap_from"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    met = F.coalesce(end > F.col("gap_from"), F.lit(False)) | F.coalesce(start < F.col("gap_to"), F.lit(False))
    hit = dealt.withColumn("_met", met).where("_found = 0 and _met").select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()
    left = asked.join(hit, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], "left_anti")
    return left.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*columns, F.lit("no break in the bars").alias("error"))


def by_rows(bars: DataFrame, width_ns: int, embargo_ns: int) -> DataFrame:
    """causal_baseline for narrow windows: symbol, event_time_ns and the three figures of _x, by a frame of rows.

    Spans of sixteen windows are the tasks; bars that windows of the next span reach are in both."""
    reach = width_ns + embargo_ns
    span, later = F.expr(f"event_time_ns div {16 * reach}"), F.expr(f"(event_time_ns + {reach}) div {16 * reach}")
    dealt = bars.withColumn("_span", F.explode(F.array_distinct(F.array(span, later)))).withColumn("_own", F.col("_span") == span)
    w = Window.partitionBy("symbol", "_span").orderBy("event_time_ns").rangeBetween(-reach, -embargo_ns - 1)
    x = F.col("_x")
    made = dealt.withColumns({"base_n": F.count(x).over(w), "base_mean": F.avg(x).over(w), "base_sd": F.stddev_pop(x).over(w)})
    return made.where("_own").select("symbol", "event_time_ns", "base_n", "base_mean", "base_sd")


def merged(parts: Column) -> Column:
    """Count, mean and sum of squares about the mean of all parts, an array of such structs; parts that are null or empty say nothing."""
    known = F.filter(parts, lambda p: p["n"] > 0)
    n = F.aggregate(known, F.lit(0).cast("long"), lambda s, p: s + p["n"])
    mean = F.aggregate(known, F.lit(0.0), lambda s, p: s + p["n"] * p["mean"]) / F.nullif(n, F.lit(0).cast("long"))
    first = F.struct(n.alias("n"), mean.alias("mean"))
    off = lambda m: F.aggregate(known, F.lit(0.0), lambda s, p: s + p["m2"] + p["n"] * (p["mean"] - m) * (p["mean"] - m))
    return F.element_at(F.transform(F.array(first), lambda f: F.struct(f["n"].alias("n"), f["mean"].alias("mean"), off(f["mean"]).alias("m2"))), 1)


def by_hours(bars: DataFrame, width_ns: int, embargo_ns: int, hour_ns: int) -> DataFrame:
    """causal_baseline for wide windows of whole hours: each distinct symbol and event_time_ns with the three figures of _x.

    A window is the rest of its first hour, whole hours, and the beginning of its last hour. Both edges are running figures within an hour, so each row is met
    twice; the hours between are one frame a symbol and hour, of as many entries as the window has hours. Nothing is subtracted."""
    wide = width_ns // hour_ns
    hour = lambda t: F.expr(f"({t} - pmod({t}, {hour_ns})) div {hour_ns}")
    x = F.col("_x")
    marks = bars.select("symbol", "event_time_ns").distinct()
    values = bars.select("symbol", F.col("event_time_ns").alias("_t"), "_x", F.lit(0).alias("_kind"), F.col("event_time_ns").alias("_of"))
    probe = lambda kind, back: marks.select("symbol", (F.col("event_time_ns") - back).alias("_t"), F.lit(None).cast("double").alias("_x"), F.lit(kind).alias("_kind"), F.col("event_time_ns").alias("_of"))
    rows = values.unionByName(probe(1, embargo_ns)).unionByName(probe(2, embargo_ns + width_ns)).withColumn("_hour", hour("_t"))
    of_hour = Window.partitionBy("symbol", "_hour")
    before = of_hour.orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    since = of_hour.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    figures = lambda over: F.struct(over(F.count(x)).alias("n"), over(F.avg(x)).alias("mean"), (over(F.var_pop(x)) * over(F.count(x))).alias("m2"))
    edges = rows.withColumns({"_before": figures(lambda a: a.over(before)), "_since": figures(lambda a: a.over(since))}).where("_kind > 0")
    hours = rows.groupBy("symbol", "_hour").agg(figures(lambda a: a).alias("_whole"))
    if wide > 1:
        span = 16 * wide
        dealt = hours.withColumn("_span", F.explode(F.array_distinct(F.array(F.floor(F.col("_hour") / span), F.floor((F.col("_hour") + wide) / span)))))
        frame = Window.partitionBy("symbol", "_span").orderBy("_hour").rangeBetween(1 - wide, -1)
        between = dealt.withColumn("_between", merged(F.collect_list("_whole").over(frame))).where(F.floor(F.col("_hour") / span) == F.col("_span")).select("symbol", "_hour", "_between")
        edges = edges.join(between, ["symbol", "_hour"])
    else:
        edges = edges.withColumn("_between", F.lit(None).cast("struct<n:bigint,mean:double,m2:double>"))
    part = lambda kind, name: F.max(F.when(F.col("_kind") == kind, F.col(name)))
    joined = edges.groupBy("symbol", F.col("_of").alias("event_time_ns")).agg(merged(F.array(part(2, "_since"), part(1, "_between"), part(1, "_before"))).alias("_all"))
    return joined.select("symbol", "event_time_ns", F.col("_all.n").alias("base_n"), F.col("_all.mean").alias("base_mean"), F.when(F.col("_all.n") > 0, F.sqrt(F.col("_all.m2") / F.col("_all.n"))).alias("base_sd"))


def causal_baseline(bars: DataFrame, column: str, width_ns: int, embargo_ns: int, hour_ns: int = 3_600_000_000_000) -> DataFrame:
    """Count, mean and deviation of the values in [t - width - embargo, t - embargo), a row a bar. Rows without symbol or time are left out.

    A width of whole hours goes by figures of hours (by_hours), any other by the rows themselves (by_rows)."""
    rows = bars.where("symbol is not null and event_time_ns is not null").select("symbol", "event_time_ns", F.col(column).cast("double").alias("_x"))
    if width_ns % hour_ns:
        return by_rows(rows, width_ns, embargo_ns)
    made = by_hours(rows, width_ns, embargo_ns, hour_ns)
    return rows.select("symbol", "event_time_ns").join(made, ["symbol", "event_time_ns"]).select(*made.columns)


def coverage(bars: DataFrame, column: str, least: int, rows: int = 1 << 16) -> DataFrame:
    """Valid values and the longest run of nulls of each symbol, and whether that is enough. Rows without symbol or time are left out.

    A run ends at the next valid row: within a bucket of rows by a window, over buckets by the last valid row before each."""
    placed = source.positions(source.sliced(bars.select("symbol", "event_time_ns", F.col(column).alias("_x")))).withColumn("bucket", F.expr(f"pos div {rows}"))
    valid = F.when(F.col("_x").isNotNull(), F.col("pos"))
    earlier = lambda x, w: F.last(x, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = placed.select("symbol", "bucket", "n", valid.alias("_valid"), (valid - earlier(valid, by_bucket()) - 1).alias("_run"))
    sums = runs.groupBy("symbol", "bucket").agg(F.max("n").alias("n"), F.count("_valid").alias("_k"), F.min("_valid").alias("_first"), F.max("_valid").alias("_last"), F.max("_run").alias("_run"))
    of_symbol = Window.partitionBy("symbol").orderBy("bucket")  # a row a bucket
    sums = sums.withColumn("_run", F.greatest("_run", F.col("_first") - F.coalesce(earlier(F.col("_last"), of_symbol), F.lit(-1)) - 1))
    n = F.max("n")
    longest = F.coalesce(F.greatest(F.max("_run"), n - 1 - F.max("_last")), n)
    out = sums.groupBy("symbol").agg(n.alias("n_rows"), F.sum("_k").alias("n_valid"), longest.alias("longest_null_run"))
    return out.withColumn("covered", (F.col("n_valid") >= F.greatest(F.lit(float(least)), 0.8 * F.col("n_rows"))) & (F.col("longest_null_run") <= 0.1 * F.col("n_rows")))


def confirmation_days(bars: DataFrame, first_day: int, least: int) -> DataFrame:
    """The longest run of consecutive days from first_day on (days since 1970), and whether it suffices to confirm."""
    days = bars.select("symbol", F.expr("event_time_ns div 86400000000000").alias("day")).distinct().where(F.col("day") >= first_day)
    runs = days.withColumn("_island", F.col("day") - F.row_number().over(Window.partitionBy("symbol").orderBy("day"))).groupBy("symbol", "_island").agg(F.count("*").alias("_k"))
    return runs.groupBy("symbol").agg(F.max("_k").alias("longest_days"), (F.max("_k") >= least).alias("can_confirm"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of the pairs without nulls; null where one side does not vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def block_correlation(bars: DataFrame, block_ns: int) -> DataFrame:
    """Correlation of log return and volume in each block of time."""
    rows = previous(bars.select("symbol", "event_time_ns", "close", "volume"), "close").select(
        "symbol", F.expr(f"event_time_ns div {block_ns}").alias("block"), (F.log("close") - F.log("previous.close")).alias("ret"), "volume")
    return rows.groupBy("symbol", "block").agg(F.count("ret").alias("n"), correlation(F.col("ret"), F.col("volume")).alias("correlation"))
