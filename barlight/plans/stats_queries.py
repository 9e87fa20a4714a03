"""Queries on statistics of signals: events and bars as series, parts and suppliers as signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.operators import specs as spec
from barlight.operators import stats
from barlight.plans.bar_queries import DAILY, HOURS, daily, hourly, sql, table
from barlight.sources.scratch import cleared, materialise, scratch_path

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test an event: a p-value that falls with the event's value, small for the first two hundredths of the ids."""
    p = F.when(F.col("event_id") % 50 == 0, F.col("event_id") % 1000 / 1e8).otherwise((F.col("event_id") * 7919 % 10007 + 1) / 10008.0)
    return table(spark, sf_dir, "events").select("event_id", p.alias("p"))


TESTS = "tests AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN event_id % 1000 / 1e8 ELSE (event_id * 7919 % 10007 + 1) / 10008.0 END AS p FROM events)"


@query(f"""WITH {TESTS}, m AS (SELECT count(*) AS m, (SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) FROM tests) + 1) t(i)) AS c FROM tests),
r AS (SELECT event_id, p, row_number() OVER (ORDER BY p, event_id) AS rank FROM tests),
b AS (SELECT *, rank * 0.1 / (m * c) AS bound FROM r, m)
SELECT event_id, rank, round(bound, 9) AS by_threshold, rank <= coalesce((SELECT max(rank) FROM b WHERE p <= bound), 0) AS rejected FROM b""")
def x8_benjamini_yekutieli(spark, sf_dir):
    made = stats.benjamini_yekutieli(tests(spark, sf_dir), "p")
    return made.select("event_id", "rank", F.round("by_threshold", 9).alias("by_threshold"), "rejected")


@query(f"""WITH {TESTS}, d AS (SELECT event_id, p AS discovery_p, CASE WHEN event_id % 3 = 0 THEN p * 2 ELSE 0.5 END AS confirm_p, CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END AS s FROM tests)
SELECT event_id, confirm_p < 0.05 AND s = 1 AND event_id % 11 <> 0 AND 30 + event_id % 9 >= 32 AS confirmed FROM d""")
def x10_confirm_rule(spark, sf_dir):
    """Confirmed: small p on the other half, the same sign, an effect of at least half the size, enough days."""
    e = tests(spark, sf_dir)
    discovery = e.select("event_id", F.lit(1).alias("sign"), F.lit(4.0).alias("effect"))
    k = F.col("event_id")
    confirm = e.select("event_id", F.when(k % 3 == 0, F.col("p") * 2).otherwise(0.5).alias("confirm_p"), F.when(k % 7 == 0, -1).otherwise(1).alias("confirm_sign"), F.when(k % 11 == 0, 1.0).otherwise(3.0).alias("confirm_effect"), (30 + k % 9).alias("days"))
    return stats.confirmed(discovery, confirm, "event_id", days=32)


@query("""WITH e AS (SELECT event_id, (value - 50) / 20 AS z, event_id % 60 + 2 AS n_effective FROM events),
t AS (SELECT *, n_effective - 1 AS v, atan(abs(z) / sqrt(n_effective - 1)) AS a, least(abs(z) / sqrt(2), 6.0) AS x FROM e),
s AS (SELECT *, cos(a) * cos(a) AS c2,
  list_reduce(list_concat([[x, x]], list_transform(range(1, 120), lambda i: [CAST(i AS DOUBLE), 0.0])), lambda s, i: [s[1] * 2 * x * x / (2 * i[1] + 1), s[2] + s[1] * 2 * x * x / (2 * i[1] + 1)])[2] AS series,
  list_reduce(list_concat([[1.0::DOUBLE, 1.0::DOUBLE]], list_transform(range(1, v // 2), lambda i: [CAST(i AS DOUBLE), 0.0])),
    lambda s, i: [s[1] * (2 * i[1] - 1) / (2 * i[1]) * cos(a) * cos(a), s[2] + s[1] * (2 * i[1] - 1) / (2 * i[1]) * cos(a) * cos(a)])[2] AS even,
  list_reduce(list_concat([[cos(a), cos(a)]], list_transform(range(1, (v - 1) // 2), lambda i: [CAST(i AS DOUBLE), 0.0])),
    lambda s, i: [s[1] * 2 * i[1] / (2 * i[1] + 1) * cos(a) * cos(a), s[2] + s[1] * 2 * i[1] / (2 * i[1] + 1) * cos(a) * cos(a)])[2] AS odd FROM t)
SELECT event_id, z, n_effective, round(1 - CASE WHEN n_effective >= 30 THEN 2 / sqrt(pi()) * exp(-x * x) * series WHEN v = 1 THEN 2 * a / pi() WHEN v % 2 = 0 THEN sin(a) * even ELSE 2 / pi() * (a + sin(a) * odd) END, 9) AS p FROM s""")
def x7_p_values(spark, sf_dir):
    """Two-sided p-values of the events' standardised values, Normal or Student-t by effective size."""
    e = table(spark, sf_dir, "events")
    z = e.select("event_id", ((F.col("value") - 50) / 20).alias("z"), (F.col("event_id") % 60 + 2).alias("n_effective"))
    return z.select("event_id", "z", "n_effective", F.round(stats.p_value(F.col("z"), F.col("n_effective")), 9).alias("p"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (abs(value - 50) / 20 > 1.959963984540054) AS beyond_5, count(*) FILTER (abs(value - 50) / 20 > 2.5758293035489) AS beyond_1, count(*) FILTER (abs(value - 50) / 20 > 2.9999769927034) AS beyond_027 FROM events GROUP BY 1""")
def x9_adaptive_threshold(spark, sf_dir):
    """Events whose standardised value is beyond the z of two-sided p-values of 5, 1 and 0.27 per cent."""
    z = F.abs(F.col("value") - 50) / 20
    beyond = {name: F.count_if(z > stats.adaptive_threshold(p)).alias(name) for name, p in (("beyond_5", 0.05), ("beyond_1", 0.01), ("beyond_027", 0.0027))}
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), *beyond.values())


EFFECTIVE = """r AS (SELECT symbol, event_time_ns, ln(close) AS x FROM bars), c AS (SELECT symbol, event_time_ns, x - avg(x) OVER (PARTITION BY symbol) AS c FROM r),
l AS (SELECT symbol, c, lag(c, 1) OVER w AS l1, lag(c, 2) OVER w AS l2, lag(c, 3) OVER w AS l3 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY event_time_ns)),
s AS (SELECT symbol, count(*) AS n, 1 + 2 * (0.75 * sum(c * l1) + 0.5 * sum(c * l2) + 0.25 * sum(c * l3)) / sum(c * c) AS ratio FROM l GROUP BY 1)"""


@query(sql(DAILY, EFFECTIVE, select="SELECT symbol, n, round(ratio, 6) AS ratio, round(greatest(1, least(n, n / greatest(ratio, 1e-9))), 4) AS n_effective FROM s"))
def x11_effective_size(spark, sf_dir):
    made = stats.effective_size(daily(spark, sf_dir).withColumn("x", F.log("close")), "x", 3)
    return made.select("symbol", "n", F.round("ratio", 6).alias("ratio"), F.round("n_effective", 4).alias("n_effective"))


@query(sql(DAILY, select="SELECT 3 AS n_columns, round(9 / (3 + 2 * (pow(corr(open, close), 2) + pow(corr(open, volume), 2) + pow(corr(close, volume), 2))), 6) AS participation FROM bars"))
def x11_participation_ratio(spark, sf_dir):
    return stats.participation_ratio(daily(spark, sf_dir), ["open", "close", "volume"]).withColumn("participation", F.round("participation", 6))


LAG = 8
PRODUCTS = ", ".join(f"sum(c * l{i}) AS s{i}" for i in range(1, LAG + 1))
LAGGED = ", ".join(f"lag(c, {i}) OVER w AS l{i}" for i in range(1, LAG + 1))
TAIL = " + ".join(f"(1 - {i} / {LAG + 1}.0) * coalesce(s{i}, 0)" for i in range(1, LAG + 1))
KINDS = ["click", "error", "purchase", "signup", "view"]
CROSS = [(a, b) for i, a in enumerate(KINDS) for b in KINDS[i + 1 :]]


@query(sql(HOURS, f"""
r AS (SELECT symbol, event_time_ns, ln(close) AS x FROM bars WHERE close > 0), c AS (SELECT symbol, event_time_ns, x - avg(x) OVER (PARTITION BY symbol) AS c FROM r),
l AS (SELECT symbol, c, {LAGGED} FROM c WINDOW w AS (PARTITION BY symbol ORDER BY event_time_ns)),
s AS (SELECT symbol, count(*) AS n, sum(c * c) AS s0, {PRODUCTS} FROM l GROUP BY 1),
e AS (SELECT max(n) AS n_rows, avg(greatest(1, least(n, n / greatest(1 + 2 * ({TAIL}) / s0, 1e-9)))) AS n_time FROM s),
w AS (SELECT event_time_ns, {", ".join(f"max(CASE WHEN symbol = '{k}' THEN x END) AS {k}" for k in KINDS)} FROM r GROUP BY 1),
p AS (SELECT 25 / (5 + 2 * ({" + ".join(f"pow(coalesce(corr({a}, {b}), 0), 2)" for a, b in CROSS)})) AS participation FROM w)""",
    select=f"SELECT n_rows, {LAG} AS lags, round(n_time, 4) AS n_time, round(participation, 6) AS participation, round(n_time * participation / 5, 4) AS n_effective FROM e, p"))
def x11_effective_observations(spark, sf_dir):
    """Hourly log prices by kind of event: serial size times the share that the kinds' correlations leave."""
    x = hourly(spark, sf_dir).where("close > 0").groupBy("event_time_ns").pivot("symbol", KINDS).agg(F.max(F.log("close")))
    made = stats.effective_observations(x, KINDS, LAG)
    return made.select("n_rows", "lags", F.round("n_time", 4).alias("n_time"), F.round("participation", 6).alias("participation"), F.round("n_effective", 4).alias("n_effective"))


@query(sql(HOURS, """y AS (SELECT symbol, volume AS x FROM bars WHERE volume > 0), s AS (SELECT symbol, count(*) AS n, sum(ln(x)) AS ls, nullif(var_pop(-1 / x), 0) AS a, nullif(var_pop((pow(x, -0.5) - 1) / -0.5), 0) AS b, nullif(var_pop(ln(x)), 0) AS c, nullif(var_pop((pow(x, 0.5) - 1) / 0.5), 0) AS d, nullif(var_pop(x), 0) AS e FROM y GROUP BY 1),
g AS (SELECT symbol, n, unnest([{'l': -1.0, 's': -n / 2 * ln(a) - 2 * ls}, {'l': -0.5, 's': -n / 2 * ln(b) - 1.5 * ls}, {'l': 0.0, 's': -n / 2 * ln(c) - ls}, {'l': 0.5, 's': -n / 2 * ln(d) - 0.5 * ls}, {'l': 1.0, 's': -n / 2 * ln(e)}], recursive := true) FROM s)""", select="SELECT symbol, n, CAST(arg_max(l, s) AS DOUBLE) AS lambda FROM g GROUP BY 1, 2"))
def x12_box_cox(spark, sf_dir):
    return stats.box_cox(hourly(spark, sf_dir), "volume", "symbol", [-1.0, -0.5, 0.0, 0.5, 1.0])


def signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("signal_id"), F.when(k % 5 != 0, F.expr("p_partkey div 10")).alias("cluster_id"), F.array("p_brand", "p_type").alias("columns"), (F.col("p_size") - 25.5).alias("effect_size"), F.lit(1).alias("tests"))


CLUSTERS = """WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey // 10 END AS c, * FROM part),
labelled AS (SELECT *, CASE WHEN id % 5 <> 0 THEN min(id) FILTER (c IS NOT NULL) OVER (PARTITION BY c) WHEN id % 20 = 0 AND (SELECT max(p_partkey) FROM part) >= id + 1 THEN NULL ELSE id END AS own FROM s),
joined AS (SELECT id, p_brand, p_type, p_size, coalesce(own, least(id, (SELECT min(x.id) FROM s x WHERE x.c = (labelled.id + 1) // 10))) AS own FROM labelled),
roots AS (SELECT id, p_brand, p_type, p_size, CASE WHEN id % 20 = 0 THEN own ELSE coalesce((SELECT j.own FROM joined j WHERE j.id % 20 = 0 AND j.id // 10 = joined.id // 10 AND joined.id % 5 <> 0 AND j.id <> joined.id), own) END AS cluster FROM joined)
"""


@query(CLUSTERS + "SELECT cluster, array_to_string(list_sort(list_distinct(flatten(list([p_brand, p_type])))), ',') AS columns, CASE WHEN arg_max(p_size - 25.5, abs(p_size - 25.5) * 1000000 + id / 10) > 0 THEN 1 ELSE -1 END AS sign, count(*) AS n_signals, count(*) AS tests_independent FROM roots GROUP BY cluster")
def x15_event_clusters(spark, sf_dir):
    """Signals of a group of ten share a cluster but every fifth, which is alone unless it links to its successor (every twentieth)."""
    s = signal_rows(spark, sf_dir)
    links = s.where("signal_id % 20 = 0").select(F.col("signal_id").alias("a"), (F.col("signal_id") + 1).alias("b")).join(s.select(F.col("signal_id").alias("b")), "b", "left_semi").select("a", "b")
    specs = stats.cluster_specs(s, stats.clusters(s.select("signal_id", "cluster_id"), links))
    return specs.withColumn("columns", F.array_join("columns", ","))


@query("SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS coverage, CASE p_partkey % 3 WHEN 0 THEN 'ANCHORED' WHEN 1 THEN 'PARTIAL' ELSE 'UNANCHORED' END AS mode FROM part")
def x16_anchor_coverage(spark, sf_dir):
    k = F.col("p_partkey") % 3
    have = F.when(k == 0, F.array("p_brand", "p_type")).when(k == 1, F.array("p_brand", F.lit("x"))).otherwise(F.array(F.lit("x")))
    share, mode = stats.anchor_mode(F.array("p_brand", "p_type"), have)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(share, 6).alias("coverage"), mode.alias("mode"))


@query("SELECT p_partkey, CASE WHEN p_size >= 24 THEN '1,4,12,24' WHEN p_size >= 12 THEN '1,4,12' WHEN p_size >= 4 THEN '1,4' ELSE '' END AS horizons, p_size BETWEEN 4 AND 23 AS clamped FROM part")
def x17_feasible_horizons(spark, sf_dir):
    band = F.array(*map(F.lit, [1, 4, 12, 24, 48]))
    fits = stats.feasible_horizons(band, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(fits, ",").alias("horizons"), F.size(fits).between(2, 3).alias("clamped"))


@query("SELECT p_partkey, sha256(p_brand || ',' || p_type || '||' || CASE WHEN p_size > 25 THEN '1' ELSE '-1' END || '||' || '1h,4h' || '||' || 'calm<wild' || '||' || 'HIGH_VOLATILITY' || '||' || 'A,N,R' || '||' || 'v1' || '||' || '100') AS fingerprint FROM part")
def x18_spec_fingerprint(spark, sf_dir):
    columns = F.array_join(F.array_sort(F.array("p_brand", "p_type")), ",")
    sign = F.when(F.col("p_size") > 25, 1).otherwise(-1)
    made = stats.fingerprint(columns, sign, F.lit("1h,4h"), F.lit("calm<wild"), F.lit("HIGH_VOLATILITY"), F.lit("A,N,R"), F.lit("v1"), F.lit(100))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("fingerprint"))


@query("SELECT p_brand, count(*) AS n, sha256(string_agg(sha256(p_partkey || '||' || p_name), ',' ORDER BY p_partkey)) AS content FROM part GROUP BY 1")
def x19_content_fingerprint(spark, sf_dir):
    """A table's content: hashes of its rows in key order, whatever its files look like."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name")
    return stats.content_fingerprint(p, "p_brand", ["p_partkey"], stats.fingerprint(F.col("p_partkey"), F.col("p_name")))


LEAVES = """leaf AS (SELECT p_brand, p_partkey // 64 AS leaf, count(*) AS n, sha256(string_agg(sha256(p_partkey || '||' || p_name), ',' ORDER BY p_partkey)) AS digest FROM part GROUP BY 1, 2)"""


def part_leaves(p: DataFrame) -> DataFrame:
    return stats.leaves(p, "p_brand", F.expr("p_partkey div 64"), ["p_partkey"], stats.fingerprint(F.col("p_partkey"), F.col("p_name")))


@query(f"WITH {LEAVES} SELECT p_brand, CAST(sum(n) AS BIGINT) AS n, count(*) AS leaves, sha256(string_agg(leaf || ':' || digest, ',' ORDER BY leaf)) AS root FROM leaf GROUP BY 1")
def x19_digest_tree(spark, sf_dir):
    """A table's content as a tree: digests of ranges of 64 keys, and of their list."""
    return stats.root(part_leaves(table(spark, sf_dir, "part")), "p_brand")


@query("SELECT DISTINCT p_brand, p_partkey // 64 AS leaf, 'changed' AS change FROM part WHERE p_partkey % 97 = 5")
def x19_changed_leaves(spark, sf_dir):
    """Every 97th name changes; the leaves that hold one of these do, no others."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 97 == 5, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    return stats.changed_leaves(part_leaves(p), part_leaves(p.withColumn("p_name", name)), "p_brand")


@query(f"""WITH {LEAVES}, r AS (SELECT p_brand, sha256(string_agg(leaf || ':' || digest, ',' ORDER BY leaf)) AS root FROM leaf GROUP BY 1)
SELECT p_brand, root, true AS same_content, false AS same_bytes FROM r""")
def x19_content_and_bytes(spark, sf_dir):
    """The same rows in files of two layouts: the content's roots agree, no file's bytes do."""
    p, roots, files = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name"), [], []
    with cleared(spark) as keep:
        for n, order in ((1, "p_partkey"), (2, "p_name")):
            path = scratch_path(spark, "layout")
            p.repartition(n).sortWithinPartitions(order).write.parquet(path)
            roots.append(materialise(stats.root(part_leaves(spark.read.schema(p.schema).parquet(path)), "p_brand").select("p_brand", "root"), "root"))
            files.append(materialise(stats.byte_fingerprint(spark, path).where("name like 'part-%'"), "bytes"))
        shared = files[0].join(files[1].withColumnRenamed("name", "_n").drop("size"), "digest").agg((F.count("*") > 0).alias("same_bytes"))
        both = roots[0].join(roots[1].withColumnRenamed("root", "_root"), "p_brand").join(F.broadcast(shared), F.lit(True))  # one row
        return keep(materialise(both.select("p_brand", "root", (F.col("root") == F.col("_root")).alias("same_content"), "same_bytes"), "compared"))


@query("SELECT p_brand AS generator, count(*) AS n, round(avg(CASE WHEN (p_size > 25) = (p_retailprice > 1000) THEN 1.0 ELSE 0.0 END), 9) AS hit_rate FROM part GROUP BY 1")
def x22_sign_hit_rate(spark, sf_dir):
    """Brands as generators: sizes above 25 say up, prices above 1000 came up, all others down."""
    up = lambda c: F.when(c, 1).otherwise(-1)
    made = stats.sign_hit_rate(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "generator"), "generator", up(F.col("p_size") > 25), up(F.col("p_retailprice") > 1000))
    return made.withColumn("hit_rate", F.round("hit_rate", 9))



CHECKS = [("N1", "p_size = 0", "no mechanism"), ("N2", "p_retailprice <= 0", "no effect"), ("N3", "length(p_type) > 20", "regime unknown"), ("N4", "p_partkey % 13 = 0", "no evidence"), ("N5", "p_brand LIKE '%5'", "horizon unknown")]


@query(" UNION ALL ".join(f"SELECT p_partkey, '{c}' AS code, '{why}' AS violation FROM part WHERE {test}" for c, test, why in CHECKS))
def x23_exit_checks(spark, sf_dir):
    """Rules as a table of conditions; a row for each that a specification breaks."""
    broken = F.array_compact(F.array(*[F.when(F.expr(test), F.struct(F.lit(c).alias("code"), F.lit(why).alias("violation"))) for c, test, why in CHECKS]))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(broken).alias("v")).select("p_partkey", "v.code", "v.violation")


# Specifications made of parts: what breaks each of the ten conditions comes from the part's key, its size and its names.
SPECS = """s AS (SELECT p_partkey AS spec_id, p_partkey AS k, p_size AS room, p_brand, [1, 4, 12, 24, 48][1:1 + p_partkey % 5] AS band,
CASE p_partkey % 11 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['p_brand', 'p_weight'] WHEN 2 THEN NULL ELSE ['p_brand', 'p_type'] END AS cols,
CASE p_partkey % 11 WHEN 0 THEN 'UNANCHORED' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'UNANCHORED' WHEN 3 THEN 'PARTIAL' ELSE 'ANCHORED' END AS mode,
CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 7 = 1 THEN NULL WHEN p_size > 25 THEN 1 ELSE -1 END AS sign,
CASE p_partkey % 13 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'calm<wild' END AS cond, CASE WHEN p_partkey % 23 = 0 THEN '' ELSE 'v1' END AS vocab FROM part),
f AS (SELECT *, sha256(concat_ws('||', coalesce(array_to_string(list_sort(cols), ','), ''), coalesce(CAST(sign AS VARCHAR), ''), array_to_string(band, ','), coalesce(cond, ''), 'HIGH_VOLATILITY', vocab)) AS own FROM s),
n AS (SELECT *, [CASE WHEN NOT (coalesce(len(cols), 0) > 0 AND k % 11 <> 1) THEN 'N1' END, CASE WHEN mode = 'UNANCHORED' THEN 'N2' END,
CASE WHEN coalesce(sign, 0) = 0 OR k % 29 < 2 THEN 'N3' END, CASE WHEN k % 13 < 2 THEN 'N4' END,
CASE WHEN len(band) > 4 OR len(list_filter(band, lambda h: h <= room)) < 2 THEN 'N5' END, CASE WHEN k % 17 = 0 OR k % 19 > 14 THEN 'N6' END,
CASE WHEN k % 10 = 0 THEN 'N7' END, CASE WHEN k % 23 = 0 OR k % 29 = 0 THEN 'N8' END,
CASE WHEN k % 4 = 0 AND NOT (mode = 'ANCHORED' AND k % 8 <> 0 AND room NOT BETWEEN 4 AND 23 AND k % 12 = 0) THEN 'N9' END, CASE WHEN k % 31 = 0 OR k % 37 = 0 THEN 'N10' END] AS v FROM f)"""


def specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    names = lambda *c: F.array(*map(F.lit, c))
    none = F.lit(None)
    made = table(spark, sf_dir, "part").select(
        k.alias("spec_id"), size.alias("room"), F.slice(F.array(*map(F.lit, [1, 4, 12, 24, 48])), 1, 1 + k % 5).alias("horizon_band"),
        F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 11 == 1, names("p_brand", "p_weight")).when(k % 11 == 2, none).otherwise(names("p_brand", "p_type")).alias("mechanism_columns"),
        F.when((k % 11).isin(0, 2), "UNANCHORED").when((k % 11).isin(1, 3), "PARTIAL").otherwise("ANCHORED").alias("anchor_mode"),
        F.when(k % 7 == 0, 0).when(k % 7 == 1, none).when(size > 25, 1).otherwise(-1).alias("predicted_sign"),
        F.when(k % 13 == 0, " ").when(k % 13 == 1, none).otherwise("calm<wild").alias("conditional_prediction"), F.lit("HIGH_VOLATILITY").alias("target_regime"),
        F.when(k % 23 == 0, "").otherwise("v1").alias("vocab_version"), F.when(k % 17 != 0, 14).alias("expansion_budget"), (k % 19).alias("expanded"),
        F.sha2(F.when(k % 10 == 0, F.lit("nowhere")).otherwise(F.col("p_brand")), 256).alias("evidence_hash"), (k % 4 == 0).alias("cemetery_eligible"), (k % 8 == 0).alias("budget_truncated"),
        size.between(4, 23).alias("horizon_clamped"), (k % 12 == 0).alias("control_failed"), (k % 31).alias("tests_independent"), F.when(k % 37 == 0, "").otherwise("gate").alias("gate_token"),
        F.when(k % 5 == 0, "HARD_BLOCK").when(k % 5 == 1, "SOFT_BLOCK").when(k % 5 == 2, "WARNING").alias("cemetery_outcome"))
    kept = F.when(F.col("spec_id") % 29 == 1, F.sha2(F.lit("before the sign was known"), 256)).when(F.col("spec_id") % 29 != 0, spec.spec_fingerprint())
    return made.withColumn("spec_fingerprint", kept)


@query(f"""WITH {SPECS}, c AS (SELECT *, list_filter(v, lambda x: x IS NOT NULL) AS bad FROM n)
SELECT spec_id, array_to_string(bad, ',') AS violated, CASE WHEN k % 29 = 1 THEN NULL ELSE own END AS fingerprint, len(bad) = 0 AND k % 5 <> 0 AS dispatch, len(bad) = 0 AND k % 5 <> 0 AND mode = 'PARTIAL' AS flagged FROM c""")
def x23_spec_checks(spark, sf_dir):
    """Conditions N1 to N10 on specifications; evidence is real if its hash is that of a brand's partition."""
    s = specifications(spark, sf_dir)
    partitions = table(spark, sf_dir, "part").select(F.sha2("p_brand", 256).alias("hash"))
    checked = spec.exit_checks(s, partitions, ["p_partkey", "p_brand", "p_type", "p_size"])
    own = s.select("spec_id", F.when(F.col("spec_id") % 29 != 1, spec.spec_fingerprint()).alias("fingerprint"))
    return checked.join(own, "spec_id").select("spec_id", F.array_join("violated", ",").alias("violated"), "fingerprint", "dispatch", "flagged")
