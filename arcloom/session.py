"""A session with the settings that this library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "arcloom", **conf: str) -> SparkSession:
    """AQE with skew joins and coalescing; zstd Parquet; filters pushed into Python sources. Further settings come as keywords with __ for dots."""
    b = SparkSession.builder.appName(name)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.parquet.compression.codec": "zstd", "spark.sql.session.timeZone": "UTC", "spark.sql.python.filterPushdown.enabled": "true"}
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
