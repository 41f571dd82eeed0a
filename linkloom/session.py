"""A session with the settings this engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "linkloom", master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session; more settings by name, with dots as double underscores (spark__driver__memory)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in more.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()
