from pyspark.sql import functions as F

from barlight.operators import ledger


def test_snapshots_group_their_parts_once(spark):
    current = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30)], "session_id long, goal_id long")
    claims = spark.createDataFrame([(10, 7), (10, 3), (99, 1), (20, 5), (20, 5)], "goal_id long, claim_id long")
    criteria = spark.createDataFrame([(10, 1, "free", 0), (10, 2, "step_2", 1), (10, 3, "step_2", 0), (10, 4, None, None), (99, 5, "step_1", 0)], "goal_id long, criterion_id long, protocol_step string, created_at long")
    evidence = spark.createDataFrame([(10, i, i // 2) for i in range(9)] + [(99, 1, 1)], "goal_id long, evidence_id long, at long")
    made = ledger.snapshots(current, claims, criteria, evidence, ["at", "evidence_id"], last=3)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join ") == 1
    got = {r.session_id: r for r in made.collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1][2:] == got[2][2:]
    ordered = [(r["goal_id"], r["criterion_id"], r["place"]) for r in ledger.criteria_order(criteria).where("goal_id = 10").orderBy("place").collect()]
    one = got[1]
    assert [c.claim_id for c in one.claims] == [3, 7] and [c.claim_id for c in got[3].claims] == [5, 5]
    assert [(10, c.criterion_id, c.place) for c in one.criteria] == ordered and [c.protocol_step for c in one.criteria] == ["step_2", "step_2", None, "free"]
    assert [(e.place, e.evidence_id) for e in one.evidence] == [(1, 6), (2, 7), (3, 8)] and one.evidence_count == 9
    assert (got[4].claims, got[4].criteria, got[4].evidence, got[4].evidence_count) == ([], [], [], 0) and got[3].evidence_count == 0
    assert made.select(F.explode("criteria").alias("c")).select("c.*").columns == ["place", "criterion_id", "protocol_step", "created_at"]
