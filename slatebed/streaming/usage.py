"""Structured Streaming twins of the usage operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Redelivered requests once; the log itself does not promise that."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])


def units_by_window(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return (
        stream.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width), "endpoint")
        .agg(F.count("*").alias("requests"), F.sum("units").alias("units"))
        .select(F.col("window.start").alias("window_start"), "endpoint", "requests", "units")
    )


def new_urls(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Rows whose query has not shown the URL within the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["query", "url"])


def first_effects(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Deliveries ``event_id, ts, ok`` that take effect: the first good one of each event."""
    good = stream.where("ok").withColumn("ts", F.col("ts").cast("timestamp"))
    return good.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
