"""The session settings that the plans of this library want."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Suppression keeps up to 1,072 candidates a group; beyond the threshold no group limit is planned.
    "spark.sql.optimizer.windowGroupLimitThreshold": "2000",
}


def builder(**settings: str) -> SparkSession.Builder:
    return SparkSession.builder.config(map=SETTINGS | settings)
