"""Spark session settings used by the library, tests and benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that can be changed on a running session. Nothing here depends on the data size:
# AQE sizes shuffle partitions and splits skewed join partitions at run time, and a side is
# broadcast only when its measured size is below spark.sql.autoBroadcastJoinThreshold.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lets small shuffles keep all cores busy; large ones are sized by the advisory size anyway.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where a distinct or group-by above it must then shuffle again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

# Settings fixed when the session starts: room for the generated code of many wide queries.
STATIC_CONF = {"spark.sql.codegen.cache.maxEntries": "1000"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "blobtide", master: str | None = None, **conf: str
) -> SparkSession:
    """Create (or get) a session with the library's settings.

    `master` is left to spark-submit when it is not given.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**STATIC_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
