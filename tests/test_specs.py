"""Exit checks of specifications on single cases: a good one, one of nulls alone, and single faults."""

import pytest
from pyspark.sql import functions as F

from barlight.operators import specs

FIELDS = (
    "spec_id int, mechanism_columns array<string>, anchor_mode string, predicted_sign int, conditional_prediction string, target_regime string, horizon_band array<int>, room int, expansion_budget int, expanded int, "
    "evidence_hash string, vocab_version string, cemetery_eligible boolean, budget_truncated boolean, horizon_clamped boolean, control_failed boolean, tests_independent int, gate_token string, cemetery_outcome string"
)
GOOD = dict(
    mechanism_columns=["open", "close"], anchor_mode="ANCHORED", predicted_sign=-1, conditional_prediction="calm<wild", target_regime="HIGH_VOLATILITY", horizon_band=[1, 4], room=24, expansion_budget=5, expanded=2,
    evidence_hash="p1", vocab_version="v1", cemetery_eligible=True, budget_truncated=False, horizon_clamped=False, control_failed=True, tests_independent=31, gate_token="t", cemetery_outcome=None,
)
CASES = [
    ({}, [], True, False),
    ({"anchor_mode": "PARTIAL", "cemetery_eligible": False, "cemetery_outcome": "SOFT_BLOCK"}, [], True, True),
    ({"cemetery_outcome": "HARD_BLOCK"}, [], False, False),
    ({"mechanism_columns": ["open", "mood"]}, ["N1"], False, False),
    ({"mechanism_columns": []}, ["N1"], False, False),
    ({"predicted_sign": 0}, ["N3"], False, False),
    ({"horizon_band": [1, 2, 3, 4, 5]}, ["N5"], False, False),
    ({"room": 1}, ["N5"], False, False),
    ({"expanded": 6}, ["N6"], False, False),
    ({"evidence_hash": "p3"}, ["N7"], False, False),
    ({"horizon_clamped": True}, ["N9"], False, False),
    ({"tests_independent": 0}, ["N10"], False, False),
    (dict.fromkeys(GOOD), ["N1", "N2", "N3", "N4", "N5", "N6", "N7", "N8", "N10"], False, False),
]


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(i, *[(GOOD | case)[c] for c in (f.split()[0] for f in FIELDS.split(", ")[1:])]) for i, (case, *_) in enumerate(CASES)]
    made = spark.createDataFrame(rows, FIELDS)
    whole = made.withColumn("spec_fingerprint", F.when(F.col("vocab_version").isNotNull(), specs.spec_fingerprint()))
    partitions = spark.createDataFrame([("p1",), ("p1",), (None,), ("p2",)], "hash string")
    return {r.spec_id: r for r in specs.exit_checks(whole, partitions, ["open", "high", "low", "close"]).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_exit_checks(checked, i):
    _, violated, dispatch, flagged = CASES[i]
    assert (checked[i].violated, checked[i].dispatch, checked[i].flagged) == (violated, dispatch, flagged)
    assert len(checked) == len(CASES)


def test_a_sign_chosen_later_breaks_the_fingerprint(spark):
    row = spark.createDataFrame([(1, *GOOD.values())], FIELDS).withColumn("spec_fingerprint", specs.spec_fingerprint()).withColumn("predicted_sign", F.lit(1))
    partitions = spark.createDataFrame([("p1",)], "hash string")
    assert specs.exit_checks(row, partitions, ["open", "close"]).first().violated == ["N3"]


def test_no_specifications(spark):
    none = spark.createDataFrame([], FIELDS + ", spec_fingerprint string")
    assert specs.exit_checks(none, spark.createDataFrame([], "hash string"), ["open"]).count() == 0
