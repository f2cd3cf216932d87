"""Sessions with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidewheel", master: str | None = None, **settings: str) -> SparkSession:
    """UTC dates and adaptive plans; further settings as name_with_underscores or via conf in the cluster's files."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()
