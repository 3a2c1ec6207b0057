"""Rates and durations in windows of event time, as sketches that add up.

A window keeps counts and a quantile sketch of its durations. Sketches of
windows merge into those of longer ones, so durations are read once, and a
stream and a batch hold the same thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketches: up to so many values are exact, ranks of more are off by about 1.7 / K.
K = 200


def by_window(requests: DataFrame, width: str = "5 minutes") -> DataFrame:
    """``requests(ts, provider, ok, duration)`` to a row for each window and provider, for tables and streams."""
    return (
        requests.groupBy(F.window("ts", width), "provider")
        .agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("errors"), F.kll_sketch_agg_double("duration", F.lit(K)).alias("durations"))
        .select(F.col("window.start").alias("window_start"), "provider", "requests", "errors", "durations")
    )


def merged(windows: DataFrame, *keys: str | Column) -> DataFrame:
    """Windows added up by other keys: all providers of a window, a day's windows."""
    sums = windows.groupBy(*keys).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("durations").alias("durations"))
    return sums


def numbers(windows: DataFrame, quantile: float = 0.95) -> DataFrame:
    """The rate of errors and the quantile of durations instead of the sketch."""
    at = F.kll_sketch_get_quantile_double("durations", F.lit(quantile))
    return windows.withColumns({"error_rate": F.col("errors") / F.col("requests"), "p95": at}).drop("durations")
