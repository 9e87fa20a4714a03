"""Queries on conversations, orders as goals and runs, line items as criteria, tasks and evidence, parts as observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.functions import text as ft
from barlight.operators import evidence, ledger, messages
from barlight.plans.bar_queries import table
from barlight.sources import logs
from barlight.sources.scratch import cleared
from barlight.sources.scratch import materialise as written

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


# ---- messages ----

MSG = "msg AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'tool' ELSE role END AS role, repeat(text, 5) AS text FROM conversations)"


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with every third assistant turn as a tool result, texts repeated five times so that some are long."""
    c = table(spark, sf_dir, "conversations")
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 1), "tool").otherwise(F.col("role"))
    return c.select("conv_id", "turn", role.alias("role"), F.repeat("text", 5).alias("text"))


def digest(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


OUT = "conv_id, turn, length(text) AS n_chars, md5(text) AS digest"


@query(f"""WITH {MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM msg),
done AS (SELECT conv_id, turn, CASE WHEN role = 'tool' AND r > 1 AND length(text) > 100 THEN '[cleared]' ELSE text END AS text FROM r) SELECT {OUT} FROM done""")
def w8_clear_old_results(spark, sf_dir):
    return digest(messages.clear_old_results(chat(spark, sf_dir), keep=1))


@query(f"""WITH {MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM msg),
done AS (SELECT conv_id, turn, CASE WHEN n > 4 AND p > 1 AND p <= n - 3 AND length(text) > 600 THEN left(text, 200) || chr(10) || chr(10) || '...[' || (length(text) - 300) || ' chars collapsed]...' || chr(10) || chr(10) || right(text, 100) ELSE text END AS text FROM r) SELECT {OUT} FROM done""")
def w9_collapse(spark, sf_dir):
    """Scaled to these conversations: the last three kept, texts over 600 characters cut to 200 and 100."""
    return digest(messages.collapse(chat(spark, sf_dir), recent=3, longest=600, head=200, tail=100))


@query(f"""WITH {MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM msg),
done AS (SELECT conv_id, turn, CASE WHEN p = 1 AND length(text) > 300 THEN left(text, 300) || chr(10) || '[System prompt truncated for payload limit]' WHEN p = 2 AND length(text) > 150 THEN left(text, 150) || chr(10) || '[User message truncated for payload limit]' ELSE text END AS text FROM r) SELECT {OUT} FROM done""")
def w10_emergency_cut(spark, sf_dir):
    return digest(messages.emergency(chat(spark, sf_dir), 300, 150))


PAIRS = """calls AS (SELECT conv_id, conv_id * 100 + turn AS call_id, turn FROM conversations WHERE role = 'user' AND turn % 3 <> 2),
results AS (SELECT conv_id, conv_id * 100 + turn - 1 AS call_id, turn, text FROM conversations WHERE role = 'assistant' AND turn % 5 <> 1)"""


@query(f"""WITH {PAIRS}
SELECT r.conv_id, r.call_id, r.turn, false AS stub FROM results r WHERE EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
UNION ALL SELECT conv_id, call_id, min(turn), true FROM calls c WHERE NOT EXISTS (SELECT 1 FROM results r WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id) GROUP BY 1, 2""")
def j6_repair_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    calls = c.where("role = 'user' and turn % 3 <> 2").select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("call_id"), "turn")
    results = c.where("role = 'assistant' and turn % 5 <> 1").select("conv_id", (F.col("conv_id") * 100 + F.col("turn") - 1).alias("call_id"), "turn", "text")
    return messages.repair_pairs(calls, results).drop("text")


@query("""WITH u AS (SELECT l_orderkey AS run_id, CAST(l_quantity AS BIGINT) AS i, CAST(round(l_discount * 100) AS BIGINT) AS o FROM lineitem WHERE l_linenumber % 4 <> 0 UNION ALL SELECT l_orderkey, 0, 0 FROM lineitem WHERE l_linenumber % 4 = 0)
SELECT run_id, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(i + o) AS BIGINT) AS total_tokens, count(*) AS calls FROM u WHERE i > 0 OR o > 0 GROUP BY run_id""")
def g9_usage_totals(spark, sf_dir):
    """Every fourth line's counts are junk or negative."""
    li = table(spark, sf_dir, "lineitem")
    bad = F.col("l_linenumber") % 4 == 0
    rows = li.select(
        F.col("l_orderkey").alias("run_id"), F.when(bad, "n/a").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("input_tokens"),
        F.when(bad, "-3").otherwise(F.round(F.col("l_discount") * 100).cast("long").cast("string")).alias("output_tokens"), F.lit(None).cast("string").alias("total_tokens"))
    return messages.usage_totals(rows, "run_id")


@query("""SELECT l_orderkey AS run_id, count(*) FILTER (l_returnflag = 'R') AS n_blocked, count(*) AS n_turns, count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_returnflag = 'R') >= 0.2 * count(*) AS rate_warning,
  count(*) FILTER (l_returnflag = 'R') >= 3 AS count_warning FROM lineitem GROUP BY 1""")
def g10_filter_warnings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return messages.filter_warnings(li.select(F.col("l_orderkey").alias("run_id"), (F.col("l_returnflag") == "R").alias("blocked")))


@query("""SELECT conv_id, md5(coalesce(arg_max(text, length(text) * 1000 - turn) FILTER (role = 'assistant' AND length(trim(text)) > 100), 'none')) AS digest FROM conversations GROUP BY conv_id""")
def g15_best_text(spark, sf_dir):
    return messages.best_text(table(spark, sf_dir, "conversations"), fallback="none").select("conv_id", F.md5("text").alias("digest"))


# ---- goals ----


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.element_at(F.array(*map(F.lit, ["active", "complete", "paused", "cancelled"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("goal_id"), status.alias("status"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("updated_at"))


GOALS = "goals AS (SELECT o_custkey AS session_id, o_orderkey AS goal_id, ['active', 'complete', 'paused', 'cancelled'][o_orderkey % 4 + 1] AS status, epoch_us(o_orderdate) AS updated_at FROM orders)"


@query(f"WITH {GOALS} SELECT session_id, arg_max(goal_id, (updated_at, goal_id)) AS goal_id, max(updated_at) AS updated_at FROM goals WHERE status IN ('active', 'paused') GROUP BY 1")
def w7_current_goal(spark, sf_dir):
    return ledger.current_goal(goals(spark, sf_dir))


ITEM = "item AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS item_id, * FROM lineitem)"


@query("""WITH e AS (SELECT o_custkey AS goal_id, o_orderkey AS evidence_id, epoch_us(o_orderdate) AS made FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY made DESC, evidence_id DESC) AS r FROM e)
SELECT goal_id, evidence_id, row_number() OVER (PARTITION BY goal_id ORDER BY made, evidence_id) AS place FROM r WHERE r <= 5""")
def w6_latest_evidence(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("goal_id"), F.col("o_orderkey").alias("evidence_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return ledger.latest(e, "goal_id", ["at", "evidence_id"], 5).select("goal_id", "evidence_id", "place")


CRITERIA = """criteria AS (SELECT DISTINCT l_orderkey AS goal_id, l_orderkey * 10 + l_linenumber AS criterion_id, l_linenumber FROM lineitem)"""


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return criteria_of(table(spark, sf_dir, "lineitem"))


def criteria_of(items: DataFrame) -> DataFrame:
    li = items.select(F.col("l_orderkey").alias("goal_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("criterion_id"), "l_linenumber").distinct()
    step = F.when(F.col("l_linenumber") % 3 == 0, "free").otherwise(F.concat(F.lit("step_"), (8 - F.col("l_linenumber")).cast("string")))
    return li.select("goal_id", "criterion_id", "l_linenumber", step.alias("protocol_step"), (F.col("criterion_id") % 3).alias("created_at"), F.when(F.col("criterion_id") % 4 == 0, "closed").otherwise("open").alias("status"))


@query(f"""WITH {CRITERIA} SELECT goal_id, criterion_id, row_number() OVER (PARTITION BY goal_id ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 2147483647 ELSE 8 - l_linenumber END, criterion_id % 3, criterion_id) AS place FROM criteria""")
def k9_criteria_order(spark, sf_dir):
    return ledger.criteria_order(criteria(spark, sf_dir)).select("goal_id", "criterion_id", "place")


EVIDENCE = "evidence AS (SELECT l_orderkey AS goal_id, l_orderkey * 10 + l_linenumber AS criterion_id FROM lineitem WHERE l_returnflag = 'R')"


def proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("goal_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("criterion_id"))


COVERAGE = f"""{CRITERIA}, {EVIDENCE},
cov AS (SELECT goal_id, count(*) AS n_criteria, count(*) FILTER (criterion_id % 4 = 0 OR EXISTS (SELECT 1 FROM evidence e WHERE e.criterion_id = c.criterion_id)) AS n_covered FROM criteria c GROUP BY 1),
num AS (SELECT goal_id, count(*) AS k FROM evidence GROUP BY 1)"""


@query(f"WITH {COVERAGE} SELECT c.goal_id, n_criteria, n_covered, coalesce(k, 0) AS n_evidence FROM cov c LEFT JOIN num ON c.goal_id = num.goal_id")
def g11_coverage(spark, sf_dir):
    return ledger.coverage(criteria(spark, sf_dir), proof(spark, sf_dir), ["open"])


@query(f"WITH {CRITERIA}, {EVIDENCE} SELECT criterion_id FROM criteria c WHERE EXISTS (SELECT 1 FROM evidence e WHERE e.criterion_id = c.criterion_id)")
def j7_criteria_with_evidence(spark, sf_dir):
    return criteria(spark, sf_dir).join(proof(spark, sf_dir), "criterion_id", "left_semi").select("criterion_id")


@query(f"""WITH {GOALS}, {COVERAGE}, cur AS (SELECT session_id, arg_max(goal_id, (updated_at, goal_id)) AS goal_id FROM goals WHERE status IN ('active', 'paused') GROUP BY 1)
SELECT session_id, cur.goal_id, coalesce(n_criteria, 0) AS n_criteria, coalesce(n_covered, 0) AS n_covered, coalesce(k, 0) AS n_evidence FROM cur LEFT JOIN cov ON cov.goal_id = cur.goal_id LEFT JOIN num ON num.goal_id = cur.goal_id""")
def a11_goal_snapshot(spark, sf_dir):
    """Current goal of each session with its coverage."""
    cov = ledger.coverage(criteria(spark, sf_dir), proof(spark, sf_dir), ["open"])
    cur = ledger.current_goal(goals(spark, sf_dir)).select("session_id", "goal_id")
    return cur.join(cov, "goal_id", "left").na.fill(0, ["n_criteria", "n_covered", "n_evidence"]).select("session_id", "goal_id", "n_criteria", "n_covered", "n_evidence")


@query(f"""WITH {GOALS}, {CRITERIA}, cur AS (SELECT session_id, arg_max(goal_id, (updated_at, goal_id)) AS goal_id FROM goals WHERE status IN ('active', 'paused') GROUP BY 1),
crit AS (SELECT goal_id, string_agg(CAST(criterion_id AS VARCHAR), ',' ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 2147483647 ELSE 8 - l_linenumber END, criterion_id % 3, criterion_id) AS criteria FROM criteria GROUP BY 1),
claim AS (SELECT goal_id, string_agg(CAST(criterion_id AS VARCHAR), ',' ORDER BY criterion_id) AS claims FROM criteria WHERE criterion_id % 2 = 0 GROUP BY 1),
ev AS (SELECT l_orderkey AS goal_id, l_partkey * 100000000 + CAST(l_extendedprice * 100 AS BIGINT) % 100000000 AS evidence_id, epoch_us(l_shipdate) AS made FROM lineitem WHERE l_returnflag = 'R'),
one AS (SELECT DISTINCT * FROM ev), last AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY made DESC, evidence_id DESC) AS r, count(*) OVER (PARTITION BY goal_id) AS k FROM one),
shown AS (SELECT goal_id, max(k) AS evidence_count, string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY made, evidence_id) AS evidence FROM last WHERE r <= 2 GROUP BY 1)
SELECT session_id, cur.goal_id, coalesce(claims, '') AS claims, coalesce(criteria, '') AS criteria, coalesce(evidence, '') AS evidence, coalesce(evidence_count, 0) AS evidence_count
FROM cur LEFT JOIN crit ON crit.goal_id = cur.goal_id LEFT JOIN claim ON claim.goal_id = cur.goal_id LEFT JOIN shown ON shown.goal_id = cur.goal_id""")
def a11_goal_documents(spark, sf_dir):
    """Current goal of each session with its claims, ordered criteria and last evidence (two pieces of it here) as nested rows."""
    with cleared(spark) as keep:
        cur = written(ledger.current_goal(goals(spark, sf_dir)).select("session_id", "goal_id"), "current")
        every = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("goal_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag")
        items = written(ledger.of_goals(every, cur.select("goal_id").distinct()), "items")
        c = criteria_of(items)
        proofs = items.where("l_returnflag = 'R'").select(
            "goal_id", (F.col("l_partkey") * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long") % 100_000_000).alias("evidence_id"),
            F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at")).distinct()
        claims = c.where("criterion_id % 2 = 0").select("goal_id", F.col("criterion_id").alias("claim_id"))
        made = ledger.snapshots(cur, claims, c, proofs, ["at", "evidence_id"], last=2)
        shown = lambda rows, k: F.array_join(F.transform(rows, lambda x: x[k].cast("string")), ",").alias(rows)
        return keep(written(made.select("session_id", "goal_id", shown("claims", "claim_id"), shown("criteria", "criterion_id"), shown("evidence", "evidence_id"), "evidence_count"), "documents"))


@query("""WITH u AS (SELECT o_custkey AS goal_id, o_orderkey AS k, sum(round(o_totalprice)) OVER w AS t, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT goal_id, k, CAST(t AS BIGINT) AS tokens_used, n AS turns_used, CASE WHEN t >= 500000 OR n >= 8 THEN 'budget_limited' ELSE 'active' END AS status FROM u""")
def g12_budget_use(spark, sf_dir):
    none = F.lit(None).cast("long")
    d = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("goal_id"), F.col("o_orderkey").alias("k"), F.round("o_totalprice").cast("long").alias("tokens"), F.lit(1).cast("long").alias("seconds"), F.lit(1).cast("long").alias("turns"),
        F.lit(500_000).alias("tokens_budget"), none.alias("seconds_budget"), F.lit(8).alias("turns_budget"))
    return ledger.budget_use(d, ["k"]).select("goal_id", "k", "tokens_used", "turns_used", "status")


@query(f"""WITH {CRITERIA},
req AS (SELECT * FROM criteria WHERE l_linenumber <> 4),
audit AS (SELECT criterion_id, ['satisfied', 'satisfied_with_caveat', 'not_applicable_user_accepted', 'open', 'satisfied'][criterion_id % 5 + 1] AS result, CASE WHEN criterion_id % 2 = 0 THEN 'agreed' ELSE ' ' END AS notes FROM criteria WHERE criterion_id % 7 <> 0),
cited AS (SELECT criterion_id, CASE WHEN criterion_id % 11 = 0 THEN -1 ELSE criterion_id END AS evidence_id FROM criteria WHERE criterion_id % 3 <> 0),
f AS (SELECT r.goal_id, r.criterion_id, CASE WHEN a.result IS NULL THEN 'missing audit row' WHEN a.result = 'open' THEN 'not satisfied' WHEN a.result LIKE 'satisfied%' AND c.evidence_id IS NULL THEN 'no evidence'
  WHEN a.result LIKE 'not%' AND trim(a.notes) = '' THEN 'no acceptance notes' WHEN c.evidence_id = -1 THEN 'unknown evidence' WHEN a.result LIKE 'satisfied%' AND r.criterion_id % 4 = 1 THEN 'no verified evidence' END AS fault
  FROM req r LEFT JOIN audit a USING (criterion_id) LEFT JOIN cited c USING (criterion_id))
SELECT * FROM f WHERE fault IS NOT NULL""")
def j9_completion_audit(spark, sf_dir):
    c = criteria(spark, sf_dir)
    k = F.col("criterion_id")
    result = F.element_at(F.array(*map(F.lit, ["satisfied", "satisfied_with_caveat", "not_applicable_user_accepted", "open", "satisfied"])), (k % 5 + 1).cast("int"))
    audit = c.where(k % 7 != 0).select("criterion_id", result.alias("result"), F.when(k % 2 == 0, "agreed").otherwise(" ").alias("notes"))
    cited = c.where(k % 3 != 0).select("criterion_id", F.when(k % 11 == 0, -1).otherwise(k).alias("evidence_id"))
    known = c.select(k.alias("evidence_id"), "goal_id", "criterion_id", (k % 4 != 1).alias("verified"))
    return ledger.completion_faults(c.withColumn("required", F.col("l_linenumber") != 4), audit, cited, known)


# ---- runs ----

TASKS = f"""{ITEM}, tasks AS (SELECT l_orderkey AS run_id, item_id AS task_id, CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_linenumber = 7 THEN 'failed' WHEN l_linenumber = 6 THEN 'cancelled' WHEN l_linenumber = 5 THEN 'running' ELSE 'completed' END AS status,
  CASE WHEN l_linenumber % 2 = 0 THEN 'report ' || item_id ELSE '' END AS summary FROM item)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with an id: their place within the order, over a total order of the columns."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return li.withColumn("item_id", F.row_number().over(w).cast("long"))


TASKS = TASKS.replace("OVER (ORDER BY l_orderkey, ", "OVER (PARTITION BY l_orderkey ORDER BY ")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    status = F.when(F.col("l_linestatus") == "F", "completed").when(F.col("l_linenumber") == 7, "failed").when(F.col("l_linenumber") == 6, "cancelled").when(F.col("l_linenumber") == 5, "running").otherwise("completed")
    summary = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("report "), F.col("item_id").cast("string"))).otherwise("")
    return i.select(F.col("l_orderkey").alias("run_id"), F.col("item_id").alias("task_id"), status.alias("status"), summary.alias("summary"))


STATUS = """st AS (SELECT run_id, CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status IN ('completed', 'cancelled')) THEN 'cancelled' ELSE 'failed' END AS status,
  CASE WHEN bool_and(status = 'completed') THEN arg_max(summary, task_id) FILTER (summary <> '') END AS final_report FROM {} GROUP BY run_id)"""


@query(f"WITH {TASKS}, {STATUS.format('tasks')} SELECT run_id, status, final_report FROM st")
def g13_run_status(spark, sf_dir):
    return ledger.run_status(tasks(spark, sf_dir))


@query(f"WITH {TASKS} SELECT run_id, CAST(min(task_id) AS VARCHAR) || ': broke at ' || min(task_id) AS error FROM tasks WHERE status = 'failed' GROUP BY run_id")
def g16_first_error(spark, sf_dir):
    error = F.when(F.col("status") == "failed", F.concat(F.lit("broke at "), F.col("task_id").cast("string")))
    return ledger.first_error(tasks(spark, sf_dir).withColumn("error", error))


@query(f"""WITH {TASKS}
SELECT run_id, task_id, CASE WHEN task_id % 3 = 0 THEN 'cancelled' ELSE status END AS status, CASE WHEN task_id % 3 = 0 THEN 'live' ELSE summary END AS summary FROM tasks
UNION ALL SELECT run_id, max(task_id) + 1, 'completed', 'extra' FROM tasks GROUP BY run_id""")
def j5_hydrate(spark, sf_dir):
    t = tasks(spark, sf_dir)
    live = t.where("task_id % 3 = 0").select("run_id", "task_id", F.lit("cancelled").alias("status"), F.lit("live").alias("summary"))
    extra = t.groupBy("run_id").agg((F.max("task_id") + 1).alias("task_id")).select("run_id", "task_id", F.lit("completed").alias("status"), F.lit("extra").alias("summary"))
    return ledger.hydrate(t, live.unionByName(extra))


RUN_EVENTS = "SELECT user_id AS run_id, event_id AS line, ts FROM events"


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"WITH e AS ({RUN_EVENTS}) SELECT run_id, epoch_us(arg_max(ts, line)) AS last_event FROM e GROUP BY run_id")
def w11_last_event(spark, sf_dir):
    return ledger.last_events(run_events(spark, sf_dir)).select("run_id", F.unix_micros("last_event").alias("last_event"))


REAP = f"""runs AS (SELECT user_id AS run_id, CASE WHEN user_id % 4 = 0 THEN 'completed' ELSE 'running' END AS status, min(ts) AS created_at FROM events GROUP BY 1),
last AS (SELECT run_id, arg_max(ts, line) AS last_event FROM ({RUN_EVENTS}) GROUP BY 1),
bound AS (SELECT max(ts) AS now FROM events),
mark AS (SELECT r.run_id, r.status, r.status = 'running' AND (epoch_us(now) - epoch_us(last_event)) / 1e6 > greatest(60, least(greatest(60, 3600 * (run_id % 5) * 10.0), 36000 * (run_id % 3 + 1) + 60)) AS is_stale FROM runs r JOIN last USING (run_id), bound),
jobs AS (SELECT user_id AS run_id, event_id AS task_id, CASE event_type WHEN 'purchase' THEN 'running' ELSE 'completed' END AS status, '' AS summary FROM events),
ended AS (SELECT j.run_id, j.task_id, CASE WHEN is_stale AND j.status = 'running' THEN 'failed' ELSE j.status END AS status, summary FROM jobs j JOIN mark USING (run_id)),
{STATUS.format('ended')}"""


@query(f"WITH {REAP} SELECT m.run_id, is_stale, CASE WHEN is_stale THEN coalesce(st.status, 'completed') ELSE m.status END AS status FROM mark m LEFT JOIN st ON st.run_id = m.run_id")
def t16_t17_reap_stale(spark, sf_dir):
    """Runs silent since before the last event of all; heartbeats and budgets by run id."""
    e = table(spark, sf_dir, "events")
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.min(F.col("ts").cast("timestamp")).alias("created_at"))
    r = F.col("run_id")
    runs = runs.withColumns({"status": F.when(r % 4 == 0, "completed").otherwise("running"), "heartbeat": 3600.0 * (r % 5), "timeout": F.lit(36_000), "retries": r % 3})
    jobs = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("task_id"), F.when(F.col("event_type") == "purchase", "running").otherwise("completed").alias("status"), F.lit("").alias("summary"))
    now = F.lit(e.agg(F.max(F.col("ts").cast("timestamp"))).first()[0])
    return ledger.reap(runs, jobs, run_events(spark, sf_dir), now)


@query("SELECT o_orderkey AS run_id, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def k8_newest_runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select(F.col("o_orderkey").alias("run_id"), "o_custkey")


@query("""SELECT o_custkey AS query, CASE WHEN bool_or(s = 0) THEN 'conflicting' WHEN bool_or(s = 1) THEN 'ambiguous' WHEN bool_or(s = 2) THEN 'locked' WHEN bool_and(s = 3) THEN 'not_found' ELSE 'unresolved' END AS status
FROM (SELECT o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 41 = 0 THEN 1 WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN 3 ELSE 4 END AS s FROM orders) GROUP BY 1""")
def g14_identity_status(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(k % 97 == 0, "conflicting").when(k % 41 == 0, "ambiguous").when(k % 3 == 0, "locked").when(k % 3 == 1, "not_found").otherwise("new")
    return ledger.identity_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), status.alias("status")), "query")


# ---- logs ----


@query("SELECT event_id, user_id, event_type FROM events")
def s6_read_jsonl(spark, sf_dir):
    """Events as JSON lines among blank and broken ones; two fields moved to a side table and restored."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    blobs = e.select(F.concat(F.lit("blobs/"), F.col("event_id").cast("string")).alias("path"), F.col("event_type").alias("text"))
    lines = e.select(F.to_json(F.struct("event_id", "user_id", F.concat(F.lit("blobs/"), F.col("event_id").cast("string")).alias("event_type_path"))).alias("value"))
    noise = e.where("event_id % 10 = 0").select(F.when(F.col("event_id") % 20 == 0, "").otherwise('{"event_id": 1, ').alias("value"))
    read = logs.parse_lines(lines.unionByName(noise), "event_id long, user_id long, event_type string, event_type_path string")
    return logs.restore(read, "event_type", blobs).select("event_id", "user_id", "event_type")


@query("""WITH d AS (SELECT doc_id, repeat(text, 12) AS text FROM documents)
SELECT doc_id, CASE WHEN length(text) > 50000 THEN 'blobs/' || left(sha256('text' || chr(0) || text), 24) END AS text_path, CASE WHEN length(text) > 50000 THEN md5(left(text, 500)) ELSE md5(text) END AS shown, CASE WHEN length(text) > 50000 THEN length(text) END AS text_size FROM d""")
def s7_offload(spark, sf_dir):
    """Texts twelve times over: those beyond 50,000 characters as a path, a preview and a size."""
    out, _ = logs.offload(table(spark, sf_dir, "documents").select("doc_id", F.repeat("text", F.lit(12)).alias("text")), "text")
    return out.select("doc_id", "text_path", F.md5(F.coalesce("text", "text_preview")).alias("shown"), F.col("text_size").cast("long").alias("text_size"))


@query(f"WITH e AS ({RUN_EVENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line) AS n FROM e) SELECT run_id, line FROM r WHERE n > 20")
def s8_tail_from_offset(spark, sf_dir):
    return logs.tail(run_events(spark, sf_dir), "run_id", "line", 20).select("run_id", "line")


# ---- evidence ----


@query("""WITH x AS (SELECT event_id AS id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT id, 'run.items[0].k' AS path, k AS value FROM x WHERE k IS NOT NULL UNION ALL SELECT id, 'run.items[1]', 2.5 FROM x UNION ALL SELECT id, 'n', 7 FROM x""")
def t14_numeric_leaves(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit('{"n": 7, "flag": true, "name": "x", "run": {"items": ['), "props", F.lit(", 2.5]}}")).alias("value"))
    return evidence.numeric_leaves(e)


CLAIMS = """obs AS (SELECT p_brand AS symbol, p_size % 3 AS field, p_retailprice AS value FROM part WHERE p_brand <> 'Brand#11'),
claims AS (SELECT p_partkey AS claim_id, p_brand AS symbol, p_size % 3 AS field, round(p_retailprice * CASE p_partkey % 3 WHEN 0 THEN 1.003 WHEN 1 THEN 1.01 ELSE 3 END, 4) AS value FROM part)"""


@query(f"""WITH {CLAIMS}, j AS (SELECT claim_id, c.symbol, c.field, c.value, bool_or(abs(c.value - o.value) <= greatest(0.005 * abs(o.value), 1e-9)) AS ok, min(o.value) AS lo, max(o.value) AS hi
  FROM claims c LEFT JOIN obs o ON o.symbol = c.symbol AND o.field = c.field GROUP BY ALL)
SELECT claim_id, symbol, field, value, CASE WHEN lo IS NULL THEN 'unavailable' WHEN ok THEN 'ok' ELSE 'conflict' END AS verdict, CASE WHEN lo IS NOT NULL AND NOT ok THEN lo END AS observed_min, CASE WHEN lo IS NOT NULL AND NOT ok THEN hi END AS observed_max FROM j""")
def j8_check_claims(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    field = F.col("p_size") % 3
    observed = p.where("p_brand <> 'Brand#11'").select(F.col("p_brand").alias("symbol"), field.alias("field"), F.col("p_retailprice").alias("value"))
    factor = F.when(F.col("p_partkey") % 3 == 0, 1.003).when(F.col("p_partkey") % 3 == 1, 1.01).otherwise(3.0)
    claims = p.select(F.col("p_partkey").alias("claim_id"), F.col("p_brand").alias("symbol"), field.alias("field"), F.round(F.col("p_retailprice") * factor, 4).alias("value"))
    return evidence.check_claims(claims, observed)


DATED = """obs AS (SELECT DISTINCT o_orderpriority AS symbol, o_orderstatus AS field, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS value FROM orders WHERE o_orderkey % 5 <> 0),
claims AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS symbol, o_orderstatus AS field, left(strftime(o_orderdate, '%Y-%m-%d'), CASE o_orderkey % 3 WHEN 0 THEN 10 ELSE 7 END) AS date,
  o_totalprice * CAST(CASE o_orderkey % 2 WHEN 0 THEN 1.004 ELSE 1.3 END AS DOUBLE) AS value FROM orders)"""


@query(f"""WITH {DATED}, j AS (SELECT claim_id, c.symbol, c.field, c.date, c.value, bool_or(abs(c.value - o.value) <= greatest(0.005 * abs(o.value), 1e-9)) AS ok, min(o.value) AS lo
  FROM claims c LEFT JOIN obs o ON o.symbol = c.symbol AND o.field = c.field AND left(o.date, 7) = left(c.date, 7) AND starts_with(o.date, c.date) GROUP BY ALL)
SELECT claim_id, symbol, field, date, value, CASE WHEN symbol IS NULL THEN 'ambiguous' WHEN lo IS NULL THEN 'unavailable' WHEN ok THEN 'ok' ELSE 'conflict' END AS verdict FROM j""")
def j8_dated_claims(spark, sf_dir):
    """Claims of a month or a day, every seventh without symbol, against observations of days."""
    o = table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    observed = o.where(k % 5 != 0).select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("field"), day.alias("date"), F.col("o_totalprice").alias("value"))
    value = F.col("o_totalprice") * F.when(k % 2 == 0, 1.004).otherwise(1.3)
    claims = o.select(k.alias("claim_id"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("symbol"), F.col("o_orderstatus").alias("field"), F.when(k % 3 == 0, day).otherwise(F.left(day, F.lit(7))).alias("date"), value.alias("value"))
    return evidence.check_claims(claims, observed).drop("observed_min", "observed_max")


@query("SELECT doc_id AS answer_id, kind, name FROM (SELECT doc_id, text, unnest([{'kind': 'symbol', 'name': lang}, {'kind': 'source', 'name': source}], recursive := true) FROM documents) WHERE NOT contains(lower(text), lower(name))")
def j10_unnamed_provenance(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cited = d.select(F.col("doc_id").alias("answer_id"), F.explode(F.array(F.struct(F.lit("symbol").alias("kind"), F.col("lang").alias("name")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("name")))).alias("c")).select("answer_id", "c.kind", "c.name")
    return evidence.unnamed_provenance(d.select(F.col("doc_id").alias("answer_id"), "text"), cited)


@query("""WITH c AS (SELECT 'brand ' || (p_partkey % 50) AS query, p_brand || '-' || p_partkey AS symbol, CASE WHEN p_partkey % 400 < 50 THEN 'Brand ' || (p_partkey % 50) ELSE 'other' END AS name, p_partkey % 1000 < 50 AS corroborated FROM part),
m AS (SELECT *, regexp_replace(lower(query), '[^a-z0-9]', '', 'g') IN (regexp_replace(lower(regexp_extract(upper(symbol), '^[^./-]*')), '[^a-z0-9]', '', 'g'), regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(symbol), '[^a-z0-9]', '', 'g')) AS exact FROM c),
g AS (SELECT query, count(*) AS n, min(symbol) AS a, count(*) FILTER (exact) AS ne, min(symbol) FILTER (exact) AS e, count(*) FILTER (corroborated) AS nc, min(symbol) FILTER (corroborated) AS k FROM m GROUP BY 1)
SELECT query, n, CASE WHEN n = 1 THEN a WHEN ne = 1 THEN e WHEN nc = 1 THEN k END AS symbol, CASE WHEN n = 1 OR ne = 1 OR nc = 1 THEN 'chosen' ELSE 'ambiguous' END AS status FROM g""")
def j11_choose_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    named = F.concat(F.lit("Brand "), (k % 50).cast("string"))
    c = p.select(F.lower(named).alias("query"), F.concat_ws("-", "p_brand", k.cast("string")).alias("symbol"), F.when(k % 400 < 50, named).otherwise("other").alias("name"), (k % 1000 < 50).alias("corroborated"))
    return evidence.choose_candidates(c)


CITED = "'In 1999 the score [[e' || doc_id % 5 || ' score=1.5]] rose by ' || doc_id % 3 || ' or ~7' || CASE WHEN doc_id % 4 = 0 THEN ' [[e9 rate=2]]' ELSE '' END"


@query("""SELECT doc_id, 'bare number' AS fault, CAST(doc_id % 3 AS VARCHAR) AS what FROM documents
UNION ALL SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN 'unknown id' WHEN 3 THEN 'not visible' ELSE 'metric not named' END, 'e' || doc_id % 5 || ' score=1.5' FROM documents WHERE doc_id % 5 IN (2, 3, 4)
UNION ALL SELECT doc_id, 'unknown id', 'e9 rate=2' FROM documents WHERE doc_id % 4 = 0""")
def x20_citation_faults(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(CITED.replace("doc_id % 5", "(doc_id % 5)").replace("doc_id % 3", "(doc_id % 3)")).alias("text"))
    known = spark.createDataFrame([("e0", "score", True), ("e1", "score", True), ("e2", "rate", True), ("e3", "score", False)], "evidence_id string, metric string, visible boolean")
    return evidence.citation_faults(d, known)


@query("""WITH h AS (SELECT user_id % 20 AS k, event_id, CASE WHEN event_id % 50 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events)
SELECT k, count(*) AS n, count(*) FILTER (isnan(v)) AS nan_count, min(v) FILTER (NOT isnan(v)) AS low, max(v) FILTER (NOT isnan(v)) AS high, greatest(count(*) - 10, 0) AS omitted, count(*) > 10 AS truncated FROM h GROUP BY 1""")
def x21_digest_statistics(spark, sf_dir):
    h = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("k"), "event_id", F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    return evidence.digest(h, "k", "v", 10)[1]


@query("""WITH r AS (SELECT user_id % 20 AS k, event_id, value AS v, row_number() OVER (PARTITION BY user_id % 20 ORDER BY abs(value) DESC, user_id % 20, event_id) AS rank FROM events) SELECT k, event_id, v, rank FROM r WHERE rank <= 10""")
def x21_digest_rows(spark, sf_dir):
    h = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("k"), "event_id", F.col("value").alias("v"))
    return evidence.digest(h, "k", "v", 10)[0]


@query("""SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'nan' ELSE 'observed' END AS status FROM events""")
def x24_evidence_status(spark, sf_dir):
    v = F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", evidence.status(v).alias("status"))


@query("""WITH c AS (SELECT doc_id, source AS code, text FROM documents) SELECT left(sha256(text), 16) AS artifact, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS n_claimed_right, count(*) FILTER (doc_id % 2 = 0 OR doc_id % 3 = 0) AS n_verified FROM c GROUP BY 1""")
def t15_artifact_hashes(spark, sf_dir):
    """Claimed hashes (right for even ids, every fourth in capitals with its prefix) against the hash of the text, and against runs that exist (every third id)."""
    d = table(spark, sf_dir, "documents")
    hash_ = F.sha2("text", 256)
    claimed = F.when(F.col("doc_id") % 4 == 0, F.upper(F.concat(F.lit("sha256:"), hash_))).when(F.col("doc_id") % 2 == 0, hash_).otherwise("0")
    runs = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("run_id"))
    both = logs.verified(d.withColumn("claimed", claimed), F.col("claimed"), F.col("text")).withColumnRenamed("verified", "right")
    checked = logs.verified(both, F.col("claimed"), F.col("text"), F.col("doc_id"), runs)
    return checked.groupBy(F.left(hash_, F.lit(16)).alias("artifact")).agg(F.count("*").alias("n"), F.count_if("right").alias("n_claimed_right"), F.count_if("verified").alias("n_verified"))


@query("""WITH i AS (SELECT conv_id, turn, json_object('code', role, 'turn', turn % 4) AS issue FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, issue ORDER BY turn) AS r FROM i) SELECT conv_id, turn FROM r WHERE r = 1""")
def k11_issue_deduplication(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.col("role").alias("code"), (F.col("turn") % 4).alias("turn"))).alias("issue"))
    return c.groupBy("conv_id", "issue").agg(F.min("turn").alias("turn")).select("conv_id", "turn")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([lower(x) FOR x IN [lang, source, upper(lang)]])), ',') AS names FROM documents")
def k13_distinct_names(spark, sf_dir):
    names = F.array_sort(F.array_distinct(F.transform(F.array("lang", "source", F.upper("lang")), lambda x: F.lower(x))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(names, ",").alias("names"))
