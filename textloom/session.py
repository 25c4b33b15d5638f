"""A session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "textloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution; ``conf`` has further settings with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
