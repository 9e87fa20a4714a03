"""Goals, criteria, evidence, budgets; runs, tasks, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.sources.scratch import materialise as written

# Fixed values.
LIVE = ["active", "paused", "waiting_user", "needs_refresh", "insufficient_evidence", "compliance_blocked", "budget_limited"]
COMPLETE = ["satisfied", "satisfied_with_caveat", "not_applicable_user_accepted"]


def latest(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key, with place counted upwards from the oldest of them."""
    w = Window.partitionBy(key)
    last = rows.withColumn("_r", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= n)
    return last.withColumn("place", F.row_number().over(w.orderBy(*order)).cast("long")).drop("_r")


def current_goal(goals: DataFrame) -> DataFrame:
    """goals: session_id, goal_id, status, updated_at. The newest live goal of each session."""
    best = F.max_by("goal_id", F.struct("updated_at", "goal_id"))
    return goals.where(F.col("status").isin(*LIVE)).groupBy("session_id").agg(best.alias("goal_id"), F.max("updated_at").alias("updated_at"))


def step_number() -> Column:
    return F.coalesce(F.nullif(F.regexp_extract("protocol_step", "^step_([0-9]+)", 1), F.lit("")).try_cast("int"), F.lit(2147483647))


def criteria_order(criteria: DataFrame) -> DataFrame:
    """criteria: goal_id, criterion_id, protocol_step, created_at. place: by step number, those without last, then creation."""
    return criteria.withColumn("place", F.row_number().over(Window.partitionBy("goal_id").orderBy(step_number(), "created_at", "criterion_id")).cast("long"))


def coverage(criteria: DataFrame, evidence: DataFrame, open_states: list[str]) -> DataFrame:
    """By goal: criteria, those covered (closed or with evidence) and pieces of evidence."""
    seen = evidence.groupBy("goal_id", "criterion_id").agg(F.count("*").alias("_k"))
    met = criteria.join(seen, ["goal_id", "criterion_id"], "left")
    covered = ~F.lower(F.coalesce("status", F.lit(""))).isin(*open_states) | F.col("_k").isNotNull()
    own = met.groupBy("goal_id").agg(F.count("*").alias("n_criteria"), F.count_if(covered).alias("n_covered"))
    total = evidence.groupBy("goal_id").agg(F.count("*").alias("n_evidence"))
    return own.join(total, "goal_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))


def of_goals(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """The rows of these goals (goal_id, each once). Ids alone are held in memory, a task's share of them; rows are met as they come, never sorted."""
    return rows.join(goals.hint("shuffle_hash"), "goal_id", "left_semi")


def snapshots(current: DataFrame, claims: DataFrame, criteria: DataFrame, evidence: DataFrame, order: list[str], last: int = 50) -> DataFrame:
    """current: session_id, goal_id; claims: goal_id, claim_id; criteria and evidence by goal_id. For each current goal its claims by id, its criteria in
    order and its last pieces of evidence, oldest first, as arrays of rows, and how much evidence there is. A goal has few claims and criteria.

    The parts are rows of one table that is written and grouped once, so no task holds the sorts and joins of each of them together."""
    wanted = current.select("goal_id").distinct()
    named = lambda rows, *not_these: [c for c in rows.columns if c not in ("goal_id", *not_these)]
    proofs = of_goals(evidence, wanted)
    shown = latest(proofs, "goal_id", order, last)
    rows = {
        "claims": (of_goals(claims, wanted), F.struct("claim_id", *named(claims, "claim_id"))), "criteria": (of_goals(criteria, wanted), F.struct(step_number().alias("_step"), "created_at", "criterion_id", F.struct(*named(criteria)).alias("_row"))),
        "evidence": (shown, F.struct("place", *named(shown, "place"))), "evidence_count": (proofs.groupBy("goal_id").agg(F.count("*").alias("_k")), F.col("_k")),
    }
    parts = [part.select("goal_id", made.alias(name)) for name, (part, made) in rows.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    nested = written(every, "parts").groupBy("goal_id").agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in ("claims", "criteria", "evidence")], F.max("evidence_count").alias("evidence_count"))
    placed = F.transform("criteria", lambda x, i: F.struct((i + 1).cast("long").alias("place"), *[x["_row"][c].alias(c) for c in named(criteria)]))
    out = current.join(nested.withColumn("criteria", placed), "goal_id", "left")
    return out.withColumns({"evidence_count": F.coalesce("evidence_count", F.lit(0)), **{c: F.coalesce(c, F.array()) for c in ("claims", "criteria", "evidence")}})


def budget_use(deltas: DataFrame, order: list[str]) -> DataFrame:
    """deltas: goal_id, tokens, seconds, turns and budgets (null: none). Running use, and budget_limited from the first crossing on."""
    w = Window.partitionBy("goal_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = deltas.withColumns({f"{c}_used": F.sum(c).over(w) for c in ("tokens", "seconds", "turns")})
    crossed = [F.coalesce(F.col(f"{c}_used") >= F.col(f"{c}_budget"), F.lit(False)) for c in ("tokens", "seconds", "turns")]
    return used.withColumn("status", F.when(crossed[0] | crossed[1] | crossed[2], "budget_limited").otherwise("active"))


def completion_faults(criteria: DataFrame, audit: DataFrame, cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Why goals cannot be completed: one row for each required criterion with its first fault.

    audit: criterion_id, result, notes; cited: criterion_id, evidence_id; evidence: evidence_id, goal_id, criterion_id, verified.
    """
    known = cited.join(evidence.select("evidence_id", F.col("goal_id").alias("_g"), F.col("criterion_id").alias("_c"), "verified"), "evidence_id", "left")
    rows = criteria.where("required").join(audit, "criterion_id", "left").join(
        known.join(criteria.select("criterion_id", "goal_id"), "criterion_id").groupBy("criterion_id").agg(
            F.count("*").alias("n"), F.count_if(F.col("_g").isNull() | (F.col("_g") != F.col("goal_id"))).alias("unknown"),
            F.count_if(F.col("_c") != F.col("criterion_id")).alias("foreign"), F.count_if(F.col("verified")).alias("ok")),
        "criterion_id", "left")
    good = F.col("result").isin("satisfied", "satisfied_with_caveat")
    fault = (
        F.when(F.col("result").isNull(), "missing audit row").when(~F.col("result").isin(*COMPLETE), "not satisfied")
        .when(good & F.col("n").isNull(), "no evidence").when((F.col("result") == "not_applicable_user_accepted") & (F.trim(F.coalesce("notes", F.lit(""))) == ""), "no acceptance notes")
        .when(F.col("unknown") > 0, "unknown evidence").when(F.col("foreign") > 0, "evidence of another criterion").when(good & (F.coalesce("ok", F.lit(0)) == 0), "no verified evidence")
    )
    return rows.select("goal_id", "criterion_id", fault.alias("fault")).where("fault is not null")


def hydrate(planned: DataFrame, live: DataFrame) -> DataFrame:
    """run_id, task_id, status, summary: live rows replace planned ones, live rows alone are added."""
    a, b = planned.alias("a"), live.alias("b")
    joined = a.join(b, (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.task_id") == F.col("b.task_id")), "full_outer")
    pick = lambda c: F.when(F.col("b.task_id").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return joined.select(*[pick(c) for c in planned.columns])


def run_status(tasks: DataFrame) -> DataFrame:
    """tasks: run_id, task_id, status, summary. Terminal status, and the last summary of a completed run as its report."""
    is_ = lambda s: F.col("status") == s
    out = tasks.groupBy("run_id").agg(
        F.bool_and(is_("completed")).alias("_all"), F.bool_or(is_("failed")).alias("_failed"), F.bool_and(F.col("status").isin("completed", "cancelled")).alias("_ended"),
        F.max_by(F.nullif("summary", F.lit("")), F.when(F.coalesce("summary", F.lit("")) != "", F.col("task_id"))).alias("_last"))
    status = F.when(F.col("_all"), "completed").when(F.col("_failed"), "failed").when(F.col("_ended"), "cancelled").otherwise("failed")
    return out.select("run_id", status.alias("status"), F.when(F.col("_all"), F.col("_last")).alias("final_report"))


def first_error(tasks: DataFrame) -> DataFrame:
    """The error of each run's first task that has one."""
    has = F.coalesce("error", F.lit("")) != ""
    return tasks.where(has).groupBy("run_id").agg(F.min_by(F.concat(F.col("task_id").cast("string"), F.lit(": "), F.col("error")), "task_id").alias("error"))


def last_events(events: DataFrame) -> DataFrame:
    """Time of the last line of each run's log."""
    return events.groupBy("run_id").agg(F.max_by("ts", "line").alias("last_event"))


def stale_after(heartbeat: Column, timeout: Column, retries: Column) -> Column:
    """Seconds of silence: ten heartbeats, at least a minute, at most the run's retry budget and a minute."""
    return F.greatest(F.lit(60.0), F.least(F.greatest(F.lit(60.0), heartbeat * 10.0), (timeout * (retries + 1) + 60).cast("double")))


def reap(runs: DataFrame, tasks: DataFrame, events: DataFrame, now: Column, live: DataFrame | None = None) -> DataFrame:
    """runs: run_id, status, created_at, heartbeat, timeout, retries. Silent running runs: their open tasks fail, status is derived from the tasks,
    of which the live rows, if there are any, replace the planned ones first."""
    tasks = tasks if live is None else hydrate(tasks, live)
    last = runs.join(last_events(events), "run_id", "left").withColumn("_at", F.coalesce("last_event", "created_at"))
    silent = (F.col("status") == "running") & ((F.unix_micros(now) - F.unix_micros("_at")) / 1e6 > stale_after(F.col("heartbeat"), F.col("timeout"), F.col("retries")))
    marked = last.select("run_id", F.col("status").alias("_status"), F.coalesce(silent, F.lit(False)).alias("is_stale"))
    open_task = F.col("is_stale") & ~F.col("status").isin("completed", "failed", "cancelled")
    ended = tasks.join(marked, "run_id").withColumn("status", F.when(open_task, "failed").otherwise(F.col("status")))
    derived = run_status(ended).select("run_id", F.col("status").alias("_derived"))
    return marked.join(derived, "run_id", "left").select("run_id", "is_stale", F.when(F.col("is_stale"), F.coalesce("_derived", F.lit("completed"))).otherwise(F.col("_status")).alias("status"))


# The first of these that occurs is the status of a set of identities.
PRECEDENCE = ["conflicting", "ambiguous", "invalidated", "unresolved", "locked", "not_found"]


def identity_status(records: DataFrame, key: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("status"))
    top = F.min(F.when(rank > 0, rank))
    return records.groupBy(key).agg(top.alias("_r"), F.count("*").alias("_n"), F.count_if(F.col("status") == "not_found").alias("_m")).select(
        key, F.when((F.col("_r") == 6) & (F.col("_m") < F.col("_n")), "unresolved").otherwise(F.coalesce(F.try_element_at(F.array(*map(F.lit, PRECEDENCE)), F.col("_r").cast("int")), F.lit("unresolved"))).alias("status"))
