"""Evidence: numeric leaves, claims against observations, citations, provenance, candidate choice."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves(value: object, most: int) -> Iterator[tuple[str, float]]:
    """Path and value of the first finite numbers of parsed JSON (its integers read as floats) in document order, at any depth."""
    open_, n = [("", value)], 0
    while open_ and n < most:
        path, v = open_.pop()
        if isinstance(v, dict):
            open_ += [(f"{path}.{k}" if path else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            open_ += [(f"{path}[{i}]", v[i]) for i in reversed(range(len(v)))]
        elif isinstance(v, float) and math.isfinite(v):
            n += 1
            yield path, v


def numeric_leaves(payloads: DataFrame, value: str = "value", key: str = "id", most: int = 2000) -> DataFrame:
    """id, path, value: finite numbers of JSON texts at any depth, booleans left out, the first `most` in document order of each row.

    Python, because variants sort the keys of an object and so lose the order. Texts that are no JSON have no leaves, nor have those that its
    parser refuses for their depth (9,000 levels are read, 50,000 are not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, paths, values = [], [], []
            for row, text in enumerate(batch.column("value").to_pylist()):
                try:
                    parsed = json.loads(text, parse_int=float) if text is not None else None
                except (ValueError, RecursionError):
                    continue
                for path, number in leaves(parsed, most):
                    source.append(row)
                    paths.append(path.encode("utf-8", "replace").decode())
                    values.append(number)
            columns = [batch.column("id").take(pa.array(source, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "path", "value"])

    given = payloads.select(F.col(key).alias("id"), F.col(value).cast("string").alias("value"))
    return given.mapInArrow(run, T.StructType([given.schema["id"], T.StructField("path", T.StringType()), T.StructField("value", T.DoubleType())]))


def band(x: Column, share: float, least: float) -> Column:
    """A whole number that grows with x, so that of two values within max(share * |o|, least) of each other (o the one observed) the numbers differ by one at most: even steps near 0, logarithmic beyond."""
    zone, width = least / share, -math.log1p(-share)
    place = F.when(F.abs(x) <= zone, F.abs(x) / least).otherwise(1 / share + F.log(F.abs(x) / zone) / width)
    return F.floor(F.signum(x) * place / 1.05).cast("long")


def check_claims(claims: DataFrame, observed: DataFrame, share: float = 0.005, least: float = 1e-9) -> DataFrame:
    """claims: claim_id, symbol, field, value (and date, ISO text or a head of it); observed: symbol, field, value (and date).

    ok if some observation of the same symbol and field, and of a date that starts with the claim's, is within its tolerance, conflict with the
    observed range if none is, unavailable without any; a claim without symbol is of the only symbol observed, ambiguous if there are several.
    Different values are dealt out by bands about as wide as the tolerance: an observation goes to its own, a claim to its own and both neighbours. In a band a
    claim's nearest observations on either side are found by merging the two sorted lists, so no claim meets every observation, and a
    symbol and field with a third of all rows is as many tasks as its values have bands. The tolerance grows with the observation, so the nearest one above and
    below in value decide.
    """
    dated = "date" in claims.columns and "date" in observed.columns
    keys = ["symbol", "field", *(["date"] if dated else [])]
    seen = observed.select(*keys, F.col("value").cast("double").alias("value")).distinct()
    given = claims.select("claim_id", *keys, F.col("value"))
    if dated:  # an observation counts for every head of its date that claims ask for: year, month, day
        heads = F.array_distinct(F.transform(F.array(*[F.lit(n) for n in (0, 4, 7, 10)]), lambda n: F.left(F.coalesce("date", F.lit("")), n)))
        seen = seen.withColumn("date", F.explode(heads)).distinct()
        given = given.withColumn("date", F.left(F.coalesce("date", F.lit("")), F.lit(10)))
    only = observed.agg(F.min("symbol").alias("_one"), (F.min("symbol") != F.max("symbol")).alias("_many"))
    given = given.join(F.broadcast(only), F.lit(True)).withColumn("_own", F.col("symbol")).withColumn("symbol", F.coalesce("symbol", F.when(~F.col("_many"), F.col("_one"))))
    ranges = seen.groupBy(*keys).agg(F.min("value").alias("observed_min"), F.max("value").alias("observed_max"))

    value = F.col("value").cast("double")
    asked = given.select(*keys, value.alias("value")).distinct().where("value is not null").withColumn("_side", F.lit(1))
    asked = asked.withColumn("_band", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: band(F.col("value"), share, least) + i)))
    both = asked.unionByName(seen.where("value is not null").withColumn("_side", F.lit(0)).withColumn("_band", band(F.col("value"), share, least)))
    of = F.when(F.col("_side") == 0, F.col("value"))
    group = Window.partitionBy(*keys, "_band")
    upto = lambda w: F.last(of, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumns({"_below": upto(group.orderBy("value", "_side")), "_above": upto(group.orderBy(F.desc("value"), "_side"))}).where("_side = 1")
    near = lambda o: F.coalesce(F.abs(F.col("value") - o) <= F.greatest(share * F.abs(o), F.lit(least)), F.lit(False))
    held = rows.groupBy(*keys, "value").agg(F.bool_or(near(F.col("_below")) | near(F.col("_above"))).alias("_ok")).where("_ok")

    met = given
    for part, on in ((ranges, keys), (held, [*keys, "value"])):
        renamed = part.select(*[F.col(c).alias(f"_k_{c}" if c in on else c) for c in part.columns])
        same = [(value if c == "value" else F.col(c)).eqNullSafe(F.col(f"_k_{c}")) for c in on]
        met = met.join(renamed, same, "left").drop(*[f"_k_{c}" for c in on])
    ambiguous = F.col("symbol").isNull() & F.coalesce("_many", F.lit(False))
    verdict = F.when(ambiguous, "ambiguous").when(F.col("observed_min").isNull(), "unavailable").when(F.col("_ok"), "ok").otherwise("conflict")
    shown = [F.when(verdict == "conflict", F.col(c)).alias(c) for c in ("observed_min", "observed_max")]
    return met.select("claim_id", F.col("_own").alias("symbol"), *keys[1:], "value", verdict.alias("verdict"), *shown)


def unnamed_provenance(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """answers: answer_id, text; cited: answer_id, kind, name. What an answer cites but does not name."""
    return cited.join(answers, "answer_id").where(~F.contains(F.lower("text"), F.lower("name"))).select("answer_id", "kind", "name")


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9㐀-鿿]", "")


def choose_candidates(candidates: DataFrame) -> DataFrame:
    """candidates: query, symbol, name, corroborated. The only one; else the only exact match; else the only corroborated one; else ambiguous."""
    base = F.regexp_extract(F.upper("symbol"), "^[^./-]*", 0)
    exact = (plain(F.col("query")) != "") & F.array_contains(F.array(plain(base), plain(F.col("name")), plain(F.col("symbol"))), plain(F.col("query")))
    g = candidates.withColumn("_exact", exact).groupBy("query").agg(
        F.count("*").alias("n"), F.min("symbol").alias("_any"), F.count_if("_exact").alias("_ne"), F.min(F.when(F.col("_exact"), F.col("symbol"))).alias("_e"),
        F.count_if("corroborated").alias("_nc"), F.min(F.when(F.col("corroborated"), F.col("symbol"))).alias("_c"))
    chosen = F.when(F.col("n") == 1, F.col("_any")).when(F.col("_ne") == 1, F.col("_e")).when(F.col("_nc") == 1, F.col("_c"))
    return g.select("query", "n", chosen.alias("symbol"), F.when(chosen.isNull(), "ambiguous").otherwise("chosen").alias("status"))


def citation_faults(texts: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """texts: key, text; known: evidence_id, metric, visible. Faults: digits outside [[...]] (years and numbers after ~ allowed), cited ids that do not
    resolve or are not visible, and citations whose text does not name the metric."""
    cites = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit("\\[\\[([^\\]]*)\\]\\]"), F.lit(1))).alias("inside"))
    cites = cites.withColumn("evidence_id", F.regexp_extract("inside", "^(e[0-9]+)", 1))
    bare = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, "\\[\\[[^\\]]*\\]\\]", " "), F.lit("(?<![\\w.~])(?!(?:19|20)\\d{2}(?![\\w.]))\\d+(?:\\.\\d+)?(?!\\w)"), F.lit(0)))).alias("what"))
    joined = cites.join(known, "evidence_id", "left")
    fault = F.when(F.col("metric").isNull(), "unknown id").when(~F.col("visible"), "not visible").when(~F.contains("inside", "metric"), "metric not named")
    return bare.select(key, F.lit("bare number").alias("fault"), "what").unionByName(joined.select(key, fault.alias("fault"), F.col("inside").alias("what")).where("fault is not null"))


def status(value: Column) -> Column:
    """nan, missing or observed: a value that is no number is kept as such, not dropped."""
    return F.when(F.isnan(value), "nan").when(value.isNull(), "missing").otherwise("observed")


def digest(rows: DataFrame, key: str, z: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The k strongest rows of each key, and min, max, count and NaN count over all of them, with how many were left out."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs(z)), *[c for c in rows.columns if c != z]))
    kept = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
    ok = F.when(~F.isnan(z), F.col(z))
    stats = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.isnan(z)).alias("nan_count"), F.min(ok).alias("low"), F.max(ok).alias("high"))
    return kept, stats.withColumns({"omitted": F.greatest(F.col("n") - k, F.lit(0)), "truncated": F.col("n") > k})
