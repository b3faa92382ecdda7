"""The session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "fathom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; keyword arguments override, with "__" for "."."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
