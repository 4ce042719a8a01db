"""The Spark session that the command line and the tests use; a program may as well bring its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "filequarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Further settings are given with dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
