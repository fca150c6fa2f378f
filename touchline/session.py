"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime re-planning does three jobs here: it merges small shuffle
# partitions, turns a join into a broadcast only after the side was measured
# to be under the threshold, and splits skewed join partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Call sites are not recorded for every column: plans here are made of
    # thousands of column calls, and each record is a round trip to the JVM.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build(app_name: str = "touchline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS applied; ``extra`` overrides single settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
