"""Gates, queues, upserts and archives: replays, breaks and reruns."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from slatebed.operators import archive, quota, upserts
from slatebed.plans.queries import finished
from slatebed.plans.state import _AUDIT, _keyed_state
from slatebed.streaming import quota as quota_stream
from slatebed.streaming.queue import UsageQueue

REQUESTS = "request_id long, workspace_id string, ts timestamp_ntz, endpoint string, units long"
SPACES = "workspace_id string, plan string, audit_retention_days int"
INCLUDED = {"free": 100, "pro": 10_000, "team": 50_000, "enterprise": 1_000_000}


def made_requests(n=900):
    rng = random.Random(9)
    start, rows = dt.datetime(2024, 1, 30, 20), []
    for i in range(n):
        space = rng.choice(["hot"] * 6 + ["w1", "w2", "w3", "lost"])
        endpoint = rng.choice(["/v1/search"] * 5 + ["/v1/similar", "/v1/other", None])
        units = rng.choice([1, 2, 3, 9, 40, 41, 97, 101, 0]) if space != "w2" else rng.choice([900, 4000])
        rows.append((i, space, start + dt.timedelta(minutes=4 * i + rng.randrange(3)), endpoint, units))
    return rows, [("hot", "free", None), ("w1", "free", None), ("w2", "pro", None), ("w3", "odd", None)]


def by_the_rule(rows, spaces):
    plans, used, out = dict((w, p if p in INCLUDED else "free") for w, p, _ in spaces), {}, {}
    for i, space, ts, endpoint, units in sorted(rows, key=lambda r: (r[2], r[0])):
        plan = plans.get(space, "free")
        window = (space, ts.date() if plan == "free" else (ts.year, ts.month))
        known = ["/v1/search", "/v1/artist", "/v1/album", "/v1/download", "/v1/probe", "/v1/license"] + ["/v1/similar"] * (plan != "free")
        before = used.get(window, 0)
        if endpoint not in known:
            out[i] = (False, "plan_endpoint_forbidden", 0, 0)
        elif plan == "free" and before + units > 100:
            out[i] = (False, "quota_exceeded_free", before, 0)
        else:
            out[i] = (True, None, before, max(0, before + units - INCLUDED[plan]))
            used[window] = before + units
    return out


def decisions(df):
    return {r.request_id: (r.allow, r.reason, r.used, r.overage) for r in df.collect()}


def test_gate_follows_the_rule_in_batch_and_stream(spark, tmp_path):
    rows, spaces = made_requests()
    df, w = spark.createDataFrame(rows, REQUESTS), spark.createDataFrame(spaces, SPACES)
    want = by_the_rule(rows, spaces)
    assert len({reason for _, reason, *_ in want.values()}) == 3 and any(o for *_, o in want.values())
    assert decisions(quota.quota_decisions(df, w)) == want
    # in files of their own, so that state goes from micro-batch to micro-batch and timers end windows
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    for k in range(6):
        folder = str(tmp_path / "in")
        spark.createDataFrame(ordered[150 * k : 150 * (k + 1)], REQUESTS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with _keyed_state(spark):
        assert decisions(finished(quota_stream.quota_gate(stream, w), "append")) == want


def test_gate_of_empty_tables(spark):
    none, w = spark.createDataFrame([], REQUESTS), spark.createDataFrame([], SPACES)
    assert quota.quota_decisions(none, w).collect() == []
    one = spark.createDataFrame([(1, None, None, "/v1/search", None)], REQUESTS)
    assert decisions(quota.quota_decisions(one, w)) == {1: (True, None, 0, 0)}


def test_messages_end_in_the_log_or_the_dead_letters_once(spark, tmp_path):
    fails = {i: i % 7 for i in range(60)}
    store = lambda rows: rows.withColumn("stored", F.when(F.col("id") == 59, None).otherwise(F.col("attempts") > F.col("id") % 7))
    queue = UsageQueue(spark, str(tmp_path / "q"), store)
    batch = lambda low, high: spark.range(low, high)
    queue.consume(batch(0, 30), 0)
    queue.consume(batch(30, 60), 1)
    queue.consume(batch(30, 60), 1)  # delivered again after a crash
    queue.drain()
    log = {r.id: r.attempts for r in queue.table("log").collect()}
    dead = {r.id: r.attempts for r in queue.table("dead").collect()}
    assert queue.table("log").count() == len(log) and queue.table("dead").count() == len(dead)
    assert log == {i: n + 1 for i, n in fails.items() if n <= 3 and i != 59}
    assert dead == {i: 4 for i, n in fails.items() if n > 3 or i == 59}


def test_a_batch_that_breaks_off_is_done_again(spark, tmp_path):
    broken = {"yes": True}

    def store(rows):
        if broken["yes"] and rows.where("id = 3 and attempts = 2").count():
            raise RuntimeError("gone")
        return rows.withColumn("stored", F.col("attempts") >= 2)

    queue = UsageQueue(spark, str(tmp_path / "q"), store)
    queue.consume(spark.range(5), 0)
    with pytest.raises(RuntimeError):
        queue.consume(spark.range(5, 8), 1)
    broken["yes"] = False
    queue.consume(spark.range(5, 8), 1)
    queue.drain()
    assert sorted((r.id, r.attempts) for r in queue.table("log").collect()) == [(i, 2) for i in range(8)]


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_two_batches_are_one_and_other_shards_stay(spark, tmp_path):
    downloads = [(f"h{i % 23}", "image/png" if i % 2 else None, 10 * (i % 23), f"u{i}", i) for i in range(200)]
    df = spark.createDataFrame(downloads, "sha256 string, mime string, bytes long, source_url string, ts long")
    shown = lambda t: sorted(map(str, t.read().withColumn("n", upserts.hit_count()).drop("hits").collect()))
    one, two = upserts.cache_index(spark, str(tmp_path / "one"), 8), upserts.cache_index(spark, str(tmp_path / "two"), 8)
    one.upsert(upserts.hits(df, "all"))
    later, sooner = df.where("ts >= 90"), df.where("ts < 90")
    for name, part in (("later", later), ("sooner", sooner), ("sooner", sooner)):
        two.upsert(upserts.hits(part, name))
    assert shown(one) == shown(two)
    before = files(tmp_path / "two")
    touched = two.upsert(upserts.hits(df.where("sha256 = 'h5'"), "more"))
    assert len(touched) == 1
    changed = before ^ files(tmp_path / "two")
    assert changed and all(f"shard={touched[0]}{os.sep}" in f for f in changed)
    assert [r.n for r in two.read().where("sha256 = 'h5'").select(upserts.hit_count().alias("n")).collect()] == [2 * sum(i % 23 == 5 for i in range(200))]
    assert two.upsert(upserts.hits(df.limit(0), "none")) == []


def test_subscriptions_and_workspaces_end_the_same_after_a_break(spark, tmp_path):
    schema = "workspace_id string, updated_at long, event_id long, customer_id string, plan string, status string, seats int"
    events = [("a", 5, 1, "c", "pro", "active", 1), ("a", 9, 2, "c", "team", "active", 5), ("b", 3, 3, "d", "free", "canceled", 1), ("x", 4, 4, "e", "pro", "active", 1)]
    df = spark.createDataFrame(events, schema)
    made = spark.createDataFrame([(w, "free", None, "k", None, 0) for w in "abc"], "workspace_id string, plan string, status string, customer_id string, event_id long, updated_at long")

    def tables(name):
        subs, spaces = upserts.subscriptions(spark, str(tmp_path / f"{name}s"), 4), upserts.workspaces(spark, str(tmp_path / f"{name}w"), 4)
        spaces.upsert(made)
        return subs, spaces

    shown = lambda t: sorted(map(str, t.read().select(sorted(t.read().columns)).collect()))
    whole, broken = tables("a"), tables("b")
    upserts.apply_events(df, *whole)
    with pytest.raises(AttributeError):
        upserts.apply_events(df.where("event_id >= 2"), broken[0], None)  # after the first table
    for part in ("event_id >= 2", "event_id < 2", "event_id >= 2"):
        upserts.apply_events(df.where(part), *broken)
    assert shown(whole[0]) == shown(broken[0]) and shown(whole[1]) == shown(broken[1])
    spaces = {r.workspace_id: (r.plan, r.status, r.customer_id) for r in whole[1].read().collect()}
    assert spaces == {"a": ("team", "active", "k"), "b": ("free", "canceled", "k"), "c": ("free", None, "k")}
    assert {r.workspace_id for r in whole[0].read().collect()} == {"a", "b", "x"}


def test_retention_can_stop_anywhere(spark, tmp_path):
    rng = random.Random(4)
    now = dt.datetime(2024, 6, 30, 3)
    rows = [(i, rng.choice(["free", "pro", "own", "lost"]), now - dt.timedelta(days=rng.randrange(400), minutes=i), None if i % 3 else "/v1/x", f'{{"k": {i}}}') for i in range(300)]
    spaces = spark.createDataFrame([("free", "free", 5), ("pro", "pro", None), ("own", "enterprise", 10)], SPACES)
    keep = {"free": 90, "pro": 180, "own": 10, "lost": 10**5}
    old = {r[0] for r in rows if r[2] < now - dt.timedelta(days=keep[r[1]])}
    log, folder = str(tmp_path / "log"), str(tmp_path / "archive")
    archive.append_log(spark.createDataFrame(rows, _AUDIT), log)
    at = F.lit("2024-06-30 03:00:00").cast("timestamp_ntz")
    limits = archive.cutoffs(spaces, at)
    ids = lambda df: sorted(r.request_id for r in df.collect())
    # stopped between archive and delete, and run again twice
    archive.archive_old(archive.read_log(spark, log, _AUDIT), limits, folder, "2024-06-30", _AUDIT)
    assert ids(archive.read_log(spark, log, _AUDIT)) == [r[0] for r in rows]
    # part of the archive is lost: those rows must not be deleted before they are written again
    lost = os.path.join(folder, "run_date=2024-06-30", "workspace=own")
    for f in os.listdir(lost):
        os.remove(os.path.join(lost, f))
    archive.delete_archived(spark, log, limits, folder, _AUDIT)
    own = {r[0] for r in rows if r[1] == "own"}
    assert ids(archive.read_log(spark, log, _AUDIT)) == sorted(set(range(300)) - (old - own))
    for _ in range(2):
        archive.retain(spark, log, spaces, at, folder, "2024-06-30", _AUDIT)
    assert ids(archive.archived(spark, folder, _AUDIT)) == sorted(old)
    assert ids(archive.read_log(spark, log, _AUDIT)) == sorted(set(range(300)) - old)
    # days without rows are gone, lines hold nulls and are in order of time
    left = {str(r[2].date()) for r in rows if r[0] not in old}
    assert {d.removeprefix("day=") for d in os.listdir(log) if d.startswith("day=")} == left
    where = os.path.join(folder, "run_date=2024-06-30", "workspace=pro")
    lines = [json.loads(x) for f in sorted(os.listdir(where)) if f.endswith(".json") for x in open(os.path.join(where, f))]
    assert [x["request_id"] for x in lines] == [r[0] for r in sorted(rows, key=lambda r: r[2]) if r[1] == "pro" and r[0] in old]
    assert all(set(x) == {"request_id", "workspace_id", "ts", "endpoint", "props"} for x in lines) and any(x["endpoint"] is None for x in lines)


def test_retention_of_nothing(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "archive")
    archive.append_log(spark.createDataFrame([(1, "w", dt.datetime(2024, 1, 1), None, None)], _AUDIT), log)
    now = F.lit("2024-06-30").cast("timestamp_ntz")
    archive.retain(spark, log, spark.createDataFrame([], SPACES), now, folder, "2024-06-30", _AUDIT)
    archive.retain(spark, log, spark.createDataFrame([("w", "team", None)], SPACES), now, folder, "2024-06-30", _AUDIT)
    assert archive.read_log(spark, log, _AUDIT).count() == 1
