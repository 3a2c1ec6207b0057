"""Gates and replays over any number of rows."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F

from slatebed.operators import usage
from slatebed.plans import queries


def _log(spark, n):
    return spark.range(n).select(
        F.lit("hot").alias("api_key"), F.timestamp_millis(1_700_000_000_000 + F.col("id") * 10).alias("ts"), F.col("id").alias("request_id"), (F.col("id") % 3 + 1).alias("units")
    )


def test_one_hot_key_streams(spark):
    n = 200_000
    log = _log(spark, n)
    bucket = usage.token_bucket(log, 2.0, 25.0)
    plans = bucket._jdf.queryExecution().toString() + usage.quota_gate(log, 50)._jdf.queryExecution().toString()
    assert "collect_list" not in plans
    level, at, allowed = 2.0, None, 0
    for i in range(n):
        ms = i * 10
        level = min(2.0, level + (0 if at is None else ms - at) * (25.0 / 1000))
        at = ms
        if level >= 1:
            level, allowed = level - 1, allowed + 1
    assert bucket.where("allowed").count() == allowed and bucket.count() == n
    gate = usage.quota_gate(log, 50)
    assert gate.count() == n and gate.agg(F.max("used")).first()[0] == 50


def test_replay_is_not_held_by_the_driver():
    assert '"memory"' not in inspect.getsource(queries._replayed)
