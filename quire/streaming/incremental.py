"""Incremental runs: new files only, late events, re-runs by source version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Process files that came since the last run, once each, and append the results as Parquet."""
    rows = spark.readStream.schema(schema).parquet(source)
    return transform(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by event type and window of a stream, repeated events and what is later than `late` left out."""
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return e.groupBy("event_type", F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def changed(current: DataFrame, stored: DataFrame, key: str = "commentary_id", version: str = "source_version") -> DataFrame:
    """Rows whose version is new or differs from the stored one."""
    return current.join(stored.select(key, version), [key, version], "left_anti")
