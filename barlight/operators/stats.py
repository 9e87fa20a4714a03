"""Statistics on signals: p-values, false-discovery control, effective sample sizes, clusters, fingerprints."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.operators.folds import folded
from barlight.operators.quality import correlation
from barlight.operators.rolling import by_bucket, with_halo
from barlight.sources import bars
from barlight.sources.scratch import materialise


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its series of Gauss-Legendre panels on a substituted integral."""
    nodes, weights = np.polynomial.legendre.leggauss(200)
    # t = x * u^2 takes the square-root singularity at zero away for a = 1/2; its powers are joined, so that x = 0 is no zero times infinity.
    u = (nodes + 1) / 2
    t = x[:, None] * u[None, :] ** 2
    f = 2 * x[:, None] ** a[:, None] * u[None, :] ** (2 * a[:, None] - 1) * (1 - t) ** (b[:, None] - 1)
    log_beta = np.array([math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q) for p, q in zip(a, b)])
    return (f @ (weights / 2)) / np.exp(log_beta)


def student_two_sided(z: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |z|) = 1 - I_{z²/(df+z²)}(1/2, df/2), or its mirror where that is the smaller one."""
    z2 = z * z
    x = z2 / (df + z2)
    small = x < 0.5
    half = np.full_like(x, 0.5)
    return np.where(small, 1 - _beta_fraction(half, df / 2, np.where(small, x, 0.25)), _beta_fraction(df / 2, half, np.where(small, 0.25, 1 - x)))


def p_value(z: Column, n_eff: Column) -> Column:
    """Two-sided; Normal from 30 effective observations on, else Student-t with n_eff - 1 degrees of freedom. No built-in function gives either."""

    @F.pandas_udf("double")
    def run(z: pd.Series, n: pd.Series) -> pd.Series:
        normal = np.array([math.erfc(abs(x) / math.sqrt(2)) for x in z])
        df = np.maximum(n.to_numpy(float) - 1, 1)
        return pd.Series(np.where(n >= 30, normal, student_two_sided(z.to_numpy(float), df))).where(z.notna() & n.notna())

    return run(z.cast("double"), n_eff.cast("double"))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed to a thousand, its expansion beyond."""
    small = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(1000)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    return F.when(n <= 1000, small).otherwise(F.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n))


def benjamini_yekutieli(tests: DataFrame, p: str, q: float = 0.1, slices: int = 4096) -> DataFrame:
    """tests with rank, p_adjusted bound (by_threshold) and rejected.

    Ranks are dealt by slices of p: counts of the slices give each one its first rank, so no task ranks all tests.
    """
    part = F.least(F.floor(F.col(p) * slices), F.lit(slices - 1)).cast("int")
    rows = tests.withColumn("_slice", part)
    counts = rows.groupBy("_slice").agg(F.count("*").alias("_k"))  # `slices` rows at most
    w = Window.orderBy("_slice")
    offsets = counts.select("_slice", (F.sum("_k").over(w) - F.col("_k")).alias("_before"), F.sum("_k").over(Window.partitionBy(F.lit(0))).alias("_m"))
    others = [c for c in tests.columns if c != p]
    ranked = rows.join(F.broadcast(offsets), "_slice").withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("_slice").orderBy(p, *others)))
    bound = F.col("rank") * q / (F.col("_m") * harmonic(F.col("_m")))
    marked = ranked.withColumn("by_threshold", bound)
    last = marked.where(F.col(p) <= F.col("by_threshold")).agg(F.max("rank").alias("_last"))
    return marked.join(F.broadcast(last), F.lit(True)).withColumn("rejected", F.col("rank") <= F.coalesce("_last", F.lit(0))).drop("_slice", "_before", "_m", "_last")


def adaptive_threshold(p: float) -> float:
    """The z beyond which a two-sided p-value is smaller."""
    return NormalDist().inv_cdf(1 - p / 2)


def confirmed(discovered: DataFrame, measured: DataFrame, key: str, p: float = 0.05, share: float = 0.5, days: int = 30) -> DataFrame:
    """discovered: key, sign, effect; measured (on the other half of the data): key, confirm_p, confirm_sign, confirm_effect, days.

    key and confirmed: a small p-value, the same sign, at least this share of the effect, and enough days; what was not measured is not confirmed."""
    same = (F.col("sign") == F.col("confirm_sign")) & (F.abs("confirm_effect") >= share * F.abs("effect"))
    both = discovered.join(measured, key, "left")
    return both.select(key, F.coalesce((F.col("confirm_p") < p) & same & (F.col("days") >= days), F.lit(False)).alias("confirmed"))


def autocovariances(series: DataFrame, x: str, lags: int, key: str = "symbol", order: str = "event_time_ns", rows: int = 1 << 16) -> DataFrame:
    """key, n, lag, cov: autocovariances about the mean, divided by n. order is a time in nanoseconds; rows without key or order are left out.

    Buckets of rows that carry the last ones of the bucket before are the tasks; there is one mean a key, joined as the planner sees fit."""
    placed = bars.positions(bars.sliced(series.select(F.col(key).alias("symbol"), F.col(order).alias("event_time_ns"), F.col(x).alias("_x"))))
    means = placed.groupBy("symbol").agg(F.avg("_x").alias("_mean"))
    centred = placed.join(means, "symbol").withColumn("_c", F.col("_x") - F.col("_mean"))
    products = [F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"s{k}") for k in range(lags + 1)]
    lagged = with_halo(centred, lags, rows).withColumns({f"_l{k}": F.lag("_c", k).over(by_bucket()) for k in range(lags + 1)}).where("own")
    sums = lagged.groupBy("symbol").agg(F.count("_c").alias("n"), *products)
    return sums.select(F.col("symbol").alias(key), "n", F.posexplode(F.array(*[F.col(f"s{k}") / F.col("n") for k in range(lags + 1)])).alias("lag", "cov"))


def effective_size(series: DataFrame, x: str, lags: int, key: str = "symbol", order: str = "event_time_ns") -> DataFrame:
    """n over the Newey-West long-run variance ratio 1 + 2 sum (1 - k/(L+1)) r_k, at least 1 and at most n."""
    cov = autocovariances(series, x, lags, key, order)
    c0 = F.max(F.when(F.col("lag") == 0, F.col("cov")))
    tail = F.sum(F.when(F.col("lag") > 0, (1 - F.col("lag") / (lags + 1)) * F.col("cov")).otherwise(0.0))
    ratio = 1 + 2 * F.try_divide(tail, c0)
    return cov.groupBy(key).agg(F.max("n").alias("n"), ratio.alias("ratio")).withColumn("n_effective", F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.try_divide("n", F.greatest("ratio", F.lit(1e-9))))))


def participation_ratio(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Effective number of independent columns: tr(R)² / ‖R‖² of their correlation matrix, one row."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = wide.agg(*[correlation(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    squares = sum((F.coalesce(F.col(f"{i}"), F.lit(0.0)) * F.coalesce(F.col(f"{i}"), F.lit(0.0)) for i in range(len(pairs))), F.lit(0.0))
    n = len(columns)
    return r.select(F.lit(n).alias("n_columns"), (n * n / (n + 2 * squares)).alias("participation"))


def effective_observations(wide: DataFrame, columns: list[str], lags: int | None = None, key: str = "statistic", order: str = "event_time_ns") -> DataFrame:
    """wide: order and columns, one statistic by instrument over time. One row: n_rows, n_time, participation, n_effective.

    n_effective is the product of the serial part, the mean over the instruments of their rows by Newey-West, and of the participation ratio as a share of the
    instruments. lags is Andrews' bandwidth 4 (n / 100)^(2/9) of the longest series if it is not given. Instruments without common rows count as uncorrelated; without any value n_effective is null."""
    long = wide.select(order, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))).alias(key, "_v")).where("_v is not null")
    if lags is None:
        n = long.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        lags = int(4 * (n / 100) ** (2 / 9))
    serial = effective_size(long, "_v", lags, key, order).agg(F.max("n").alias("n_rows"), F.avg("n_effective").alias("n_time"))
    both = serial.join(participation_ratio(wide, columns), F.lit(True))  # one row each
    return both.select("n_rows", F.lit(lags).alias("lags"), "n_time", "participation", (F.col("n_time") * F.col("participation") / F.col("n_columns")).alias("n_effective"))


def tested(found: DataFrame, z: str, size: DataFrame, q: float = 0.1) -> DataFrame:
    """found with p and Benjamini-Yekutieli's verdict; size: effective_observations of the statistic that z stands for."""
    with_size = found.join(F.broadcast(size.select(F.col("n_effective").alias("n_effective"))), F.lit(True))  # one row
    return benjamini_yekutieli(with_size.withColumn("p", p_value(F.col(z), F.col("n_effective"))), "p", q)


def box_cox(series: DataFrame, x: str, key: str, grid: list[float]) -> DataFrame:
    """key, lambda: of the grid, by the profile log-likelihood of positive values; null if none has variance."""
    y = F.when(F.col(x) > 0, F.col(x))
    steps = {g: F.log(y) if abs(g) < 1e-12 else (F.pow(y, F.lit(g)) - 1) / g for g in grid}
    sums = series.groupBy(key).agg(F.count(y).alias("n"), F.sum(F.log(y)).alias("ls"), *[F.var_pop(v).alias(f"v{i}") for i, v in enumerate(steps.values())])
    scores = [F.when(F.col(f"v{i}") > 0, F.struct((-F.col("n") / 2 * F.log(f"v{i}") + (g - 1) * F.col("ls")).alias("score"), F.lit(g).alias("lambda"))) for i, g in enumerate(grid)]
    return sums.select(key, "n", F.array_max(F.array_compact(F.array(*scores)))["lambda"].alias("lambda"))


def clusters(signals: DataFrame, links: DataFrame) -> DataFrame:
    """signals: signal_id, cluster_id (may be null); links: a, b. signal_id, cluster: smallest id of those connected by cluster or link."""
    hubs = signals.where("cluster_id is not null").groupBy("cluster_id").agg(F.min("signal_id").alias("hub"))
    edges = links.select("a", "b").unionByName(signals.join(hubs, "cluster_id").select(F.col("signal_id").alias("a"), F.col("hub").alias("b"))).where("a <> b")
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialise(signals.select("signal_id", F.col("signal_id").alias("cluster")), "labels")
    while True:
        near = both.join(label, both.b == label.signal_id).groupBy("a").agg(F.min("cluster").alias("m"))
        met = label.join(near, label.signal_id == near.a, "left").select("signal_id", F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"))
        jump = met.select(F.col("signal_id").alias("cluster"), F.col("cluster").alias("root"))
        new = materialise(met.join(jump, "cluster").select("signal_id", F.col("root").alias("cluster")), "labels")
        if new.join(label, ["signal_id", "cluster"], "left_anti").isEmpty():
            return new
        label = new


def cluster_specs(signals: DataFrame, of: DataFrame) -> DataFrame:
    """One row a cluster: union of columns, sign of the strongest effect, sum of the independent tests. Only the different columns of a cluster are gathered."""
    rows = signals.join(of, "signal_id")
    names = rows.select("cluster", F.explode("columns").alias("_c")).distinct().groupBy("cluster").agg(F.array_sort(F.collect_list("_c")).alias("columns"))
    sums = rows.groupBy("cluster").agg(
        F.when(F.max_by("effect_size", F.struct(F.abs("effect_size"), "signal_id")) > 0, 1).otherwise(-1).alias("sign"),
        F.count("*").alias("n_signals"), F.sum("tests").alias("tests_independent"))
    return sums.join(names, "cluster", "left").select("cluster", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), "sign", "n_signals", "tests_independent")


def sign_hit_rate(forecasts: DataFrame, key: str, said: Column, came: Column) -> DataFrame:
    """key, n, hit_rate: share of the forecasts whose sign came true. A flat outcome is a miss, unless flat was said; forecasts without outcome are left out."""
    signs = forecasts.select(key, F.signum(said).alias("_said"), F.signum(came).alias("_came")).where("_said is not null and _came is not null")
    return signs.groupBy(key).agg(F.count("*").alias("n"), F.avg((F.col("_said") == F.col("_came")).cast("double")).alias("hit_rate"))


def anchor_mode(columns: Column, vocabulary: Column) -> tuple[Column, Column]:
    """Share of the columns that the vocabulary has, and ANCHORED, PARTIAL or UNANCHORED."""
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(columns, vocabulary)), F.size(F.array_distinct(columns))), F.lit(0.0))
    return share, F.when(share == 1, "ANCHORED").when(share > 0, "PARTIAL").otherwise("UNANCHORED")


def feasible_horizons(band: Column, room: Column, most: int = 4) -> Column:
    """Horizons that fit into the room, at most four of the band; fewer than two are none."""
    fits = F.filter(F.slice(band, 1, most), lambda h: h <= room)
    return F.when(F.size(fits) < 2, F.array().cast("array<int>")).otherwise(fits)


def content_fingerprint(rows: DataFrame, key: str, order: list[str], row_hash: Column) -> DataFrame:
    """key, n, content: sha256 over the hashes of a key's rows in order (rows that tie, by hash), whatever their files look like. Read one by one, none is gathered."""

    def content(group: Iterator[dict]) -> Iterator[dict]:
        whole = hashlib.sha256()
        for n, row in enumerate(group):
            whole.update(f",{row['_h']}".encode() if n else row["_h"].encode())
        yield {key: row[key], "n": n + 1, "content": whole.hexdigest()}

    given = rows.select(key, *order, row_hash.alias("_h"))
    return folded(given, [key], [*order, "_h"], content, f"`{key}` {rows.schema[key].dataType.simpleString()}, n long, content string")


def leaves(rows: DataFrame, key: str, leaf: Column, order: list[str], row_hash: Column) -> DataFrame:
    """key, leaf, n, digest: sha256 over the hashes of the rows of each fixed range of a key's order, in that order (rows that tie, by hash).

    leaf numbers the ranges and has to grow with the order; it depends on a row's own values alone, so a changed row changes one leaf. A key is as many tasks as it has leaves."""

    def content(group: Iterator[dict]) -> Iterator[dict]:
        whole = hashlib.sha256()
        for n, row in enumerate(group):
            whole.update(f",{row['_h']}".encode() if n else row["_h"].encode())
        yield {key: row[key], "leaf": row["leaf"], "n": n + 1, "digest": whole.hexdigest()}

    given = rows.select(key, leaf.cast("long").alias("leaf"), *order, row_hash.alias("_h"))
    return folded(given, [key, "leaf"], [*order, "_h"], content, f"`{key}` {rows.schema[key].dataType.simpleString()}, leaf long, n long, digest string")


def root(leaves: DataFrame, key: str) -> DataFrame:
    """key, n, leaves (how many), root: sha256 over the numbers and digests of a key's leaves in order, read one by one."""

    def content(group: Iterator[dict]) -> Iterator[dict]:
        whole, n = hashlib.sha256(), 0
        for i, row in enumerate(group):
            whole.update(f"{',' * (i > 0)}{row['leaf']}:{row['digest']}".encode())
            n += row["n"]
        yield {key: row[key], "n": n, "leaves": i + 1, "root": whole.hexdigest()}

    return folded(leaves, [key], ["leaf"], content, f"`{key}` {leaves.schema[key].dataType.simpleString()}, n long, leaves long, root string")


def changed_leaves(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, leaf, change (changed, new or gone) of two tables of leaves: what has to be compared row by row."""
    a, b = (x.select(F.col(key).alias(f"_{i}"), F.col("leaf").alias(f"_l{i}"), F.col("digest").alias(f"_d{i}")) for i, x in enumerate((before, after)))
    met = a.join(b, F.col("_0").eqNullSafe(F.col("_1")) & F.col("_l0").eqNullSafe(F.col("_l1")), "full_outer")
    change = F.when(F.col("_d0").isNull(), "new").when(F.col("_d1").isNull(), "gone").when(F.col("_d0") != F.col("_d1"), "changed")
    return met.select(F.coalesce("_0", "_1").alias(key), F.coalesce("_l0", "_l1").alias("leaf"), change.alias("change")).where("change is not null")


def byte_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """name, size, digest: sha256 over the bytes of each file below a folder, whatever is in them. A file is read whole by one task; Spark refuses those of 2 GB and more."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def fingerprint(*fields: Column) -> Column:
    """sha256 over the fields' canonical texts; arrays have to be sorted by the caller."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)
