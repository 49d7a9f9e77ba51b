"""A session with the settings that the operators are tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "trawlspark", **settings: str) -> SparkSession:
    """Adaptive execution and UTC; everything else is left to the cluster's defaults or to ``settings``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
