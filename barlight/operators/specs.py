"""Specifications of hypotheses: what has to hold before one is dispatched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.operators.stats import feasible_horizons, fingerprint


def _given(text: Column) -> Column:
    return F.length(F.trim(text)) > 0


def spec_fingerprint() -> Column:
    """Over the fields that are fixed before dispatch: columns, sign, horizons, condition, regime, vocabulary."""
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return fingerprint(joined("mechanism_columns"), F.col("predicted_sign"), joined("horizon_band"), F.col("conditional_prediction"), F.col("target_regime"), F.col("vocab_version"))


def exit_checks(specs: DataFrame, partitions: DataFrame, schema: list[str], key: str = "spec_id") -> DataFrame:
    """key, violated (codes N1 to N10 in this order), dispatch, flagged; a row for each row of specs.

    specs: key, mechanism_columns, anchor_mode, predicted_sign, spec_fingerprint, conditional_prediction, target_regime, horizon_band (integers), room
    (the longest horizon that fits), expansion_budget, expanded, evidence_hash, vocab_version, cemetery_eligible, budget_truncated, horizon_clamped,
    control_failed, tests_independent, gate_token, cemetery_outcome; partitions: hash, of the data there is; schema: the columns of the data.

    A condition on a null does not hold; of the outcomes HARD_BLOCK alone blocks; what is PARTIAL is dispatched with a flag.
    """
    known = partitions.select(F.col("hash").alias("evidence_hash")).where("evidence_hash is not null").distinct().withColumn("_real", F.lit(True))
    own = F.col("mechanism_columns")
    never = F.lit(False)
    buried = (F.col("anchor_mode") == "ANCHORED") & ~F.coalesce("budget_truncated", never) & ~F.coalesce("horizon_clamped", never) & F.coalesce("control_failed", never)
    holds = {
        "N1": (F.size(own) > 0) & (F.size(F.array_except(own, F.array(*map(F.lit, schema)))) == 0),
        "N2": F.col("anchor_mode").isin("ANCHORED", "PARTIAL"),
        "N3": F.col("predicted_sign").isin(1, -1) & (F.col("spec_fingerprint") == spec_fingerprint()),
        "N4": _given(F.col("conditional_prediction")),
        "N5": F.size("horizon_band").between(1, 4) & (F.size(feasible_horizons(F.col("horizon_band"), F.col("room"))) > 0),
        "N6": F.col("expansion_budget").isNotNull() & (F.coalesce("expanded", F.lit(0)) <= F.col("expansion_budget")),
        "N7": F.col("_real"),
        "N8": _given(F.col("vocab_version")) & _given(F.col("spec_fingerprint")),
        "N9": ~F.coalesce("cemetery_eligible", never) | buried,
        "N10": (F.col("tests_independent") >= 1) & _given(F.col("gate_token")),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(ok, never), F.lit(None)).otherwise(F.lit(code)) for code, ok in holds.items()]))
    checked = specs.join(known, "evidence_hash", "left").withColumn("violated", broken)
    goes = (F.size("violated") == 0) & ~F.col("cemetery_outcome").eqNullSafe(F.lit("HARD_BLOCK"))
    return checked.select(key, "violated", goes.alias("dispatch"), (goes & (F.col("anchor_mode") == "PARTIAL")).alias("flagged"))
