"""Message lists: compaction, orphan repair, usage totals, best texts. Rows: conv_id, turn, role, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLEARED = "[cleared]"
STUB = "[Result from earlier context — see summary above]"


def conversation() -> Window:
    return Window.partitionBy("conv_id")


def clear_old_results(messages: DataFrame, keep: int = 3, longer: int = 100) -> DataFrame:
    """Tool texts longer than `longer` but the last `keep` of each conversation are blanked."""
    from_end = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    old = (F.col("role") == "tool") & (from_end > keep) & (F.length("text") > longer)
    return messages.withColumn("text", F.when(old, CLEARED).otherwise(F.col("text")))


def collapse(messages: DataFrame, recent: int = 6, longest: int = 2400, head: int = 900, tail: int = 500) -> DataFrame:
    """Long texts that are neither the first message nor among the last `recent` keep their head and tail."""
    place, n = F.row_number().over(conversation().orderBy("turn")), F.count("*").over(conversation())
    middle = (n > recent + 1) & (place > 1) & (place <= n - recent) & (F.length("text") > longest)
    text = F.col("text")
    short = F.concat(F.substring(text, 1, head), F.lit("\n\n...["), (F.length(text) - head - tail).cast("string"), F.lit(" chars collapsed]...\n\n"), F.right(text, F.lit(tail)))
    return messages.withColumn("text", F.when(middle, short).otherwise(text))


def emergency(messages: DataFrame, system: int = 3000, user: int = 1500) -> DataFrame:
    """The first message is cut to `system` characters, the second to `user`."""
    place, text = F.row_number().over(conversation().orderBy("turn")), F.col("text")
    cut = lambda n, what: F.concat(F.substring(text, 1, n), F.lit(f"\n[{what} truncated for payload limit]"))
    out = F.when((place == 1) & (F.length(text) > system), cut(system, "System prompt")).when((place == 2) & (F.length(text) > user), cut(user, "User message"))
    return messages.withColumn("text", F.coalesce(out, text))


def repair_pairs(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls and results: conv_id, call_id, turn (and name, text). Results without call go; calls without result get a stub after them."""
    kept = results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_semi")
    missing = calls.join(results.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    return kept.select("conv_id", "call_id", "turn", "text", F.lit(False).alias("stub")).unionByName(missing.select("conv_id", "call_id", "turn", F.lit(STUB).alias("text"), F.lit(True).alias("stub")))


def count_of(value: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.coalesce(value.try_cast("long"), F.lit(0).cast("long")))


def usage_totals(events: DataFrame, key: str) -> DataFrame:
    """events: key, input_tokens, output_tokens, total_tokens (text or numbers). Junk and negatives count as none; all-zero events are no calls."""
    i, o, t = (count_of(F.col(c)) for c in ("input_tokens", "output_tokens", "total_tokens"))
    rows = events.select(key, i.alias("i"), o.alias("o"), F.when(t == 0, i + o).otherwise(t).alias("t")).where("i > 0 or o > 0 or t > 0")
    return rows.groupBy(key).agg(F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum("t").alias("total_tokens"), F.count("*").alias("calls"))


def best_text(messages: DataFrame, role: str = "assistant", longer: int = 100, fallback: str = "") -> DataFrame:
    """The longest text of a role beyond `longer` characters; the earliest of equals; else the fallback."""
    fits = (F.col("role") == role) & (F.length(F.trim("text")) > longer)
    best = F.max_by(F.when(fits, F.col("text")), F.when(fits, F.struct(F.length("text"), -F.col("turn"))))
    return messages.groupBy("conv_id").agg(F.coalesce(best, F.lit(fallback)).alias("text"))


def filter_warnings(runs: DataFrame, rate: float = 0.2, many: int = 3) -> DataFrame:
    """runs: run_id, blocked (boolean for each turn). Share and count of blocked turns, and which of the two warnings they give."""
    counted = runs.groupBy("run_id").agg(F.count_if("blocked").alias("n_blocked"), F.count("*").alias("n_turns"))
    return counted.withColumns({"rate_warning": (F.col("n_blocked") > 0) & (F.col("n_blocked") >= rate * F.col("n_turns")), "count_warning": F.col("n_blocked") >= many})
