"""The engine's session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC pins every timestamp; adaptive execution resizes and splits shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", name: str = "pagetide", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(name)
    for k, v in {**SETTINGS, **extra}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
