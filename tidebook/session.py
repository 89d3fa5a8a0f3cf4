"""A session with the settings this engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidebook", **conf: str) -> SparkSession:
    """UTC, adaptive plans with skewed joins split; everything else as the cluster sets it."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
