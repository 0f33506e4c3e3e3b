"""A session with the settings that the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow transfer; further settings as keywords with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
