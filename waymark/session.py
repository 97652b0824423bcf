"""Session settings that the operators are tuned for. Any session works; these only help."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot join keys also where a shuffle has to be added for it.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A join on (customer, cell) may reuse a shuffle on a part of its keys.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Hash instead of sort-merge joins where the measured partitions are small enough.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Estimates of files are far below what they hold, as Parquet packs repeated values: tables of millions of places looked small.
    # So files are broadcast only where tiny, and what has been shuffled by its measured size.
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "2m",
    # What a job has shuffled goes when it ends, instead of whenever the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, app_name: str = "waymark", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
