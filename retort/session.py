"""Session settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "retort", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer on."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
