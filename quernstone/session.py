"""A session with the settings that the queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, app: str = "quernstone", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow; further settings as keyword ``spark_x_y=value``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
