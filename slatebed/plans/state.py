"""Named queries of the operators that hold state: gates, queues, upserts, archives."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatebed.operators import archive, quota, upserts
from slatebed.plans.inputs import read
from slatebed.plans.inputs import usage as usage_of
from slatebed.plans.inputs import workspaces as workspaces_of
from slatebed.plans.queries import U, event_stream, finished, query
from slatebed.sources.shared import new_path
from slatebed.streaming import quota as quota_stream
from slatebed.streaming.queue import UsageQueue

# -- quota

#: Requests that are dear enough for the free plan's cap: thrice the event's value in units.
_DEAR = "floor(value * 3)"
_GATE = f"""with recursive u as (select request_id, ts, workspace_id, endpoint, cast({_DEAR} as bigint) as units from ({{usage}})), w as ({{workspaces}}),
j as (select u.*, case when w.plan in ('pro', 'team', 'enterprise') then w.plan else 'free' end as plan from u left join w on u.workspace_id = w.workspace_id),
p as (select *, case when plan = 'free' then date_trunc('day', ts) else date_trunc('month', ts) end as win, case plan when 'free' then 100 when 'pro' then 10000 when 'team' then 50000 else 1000000 end as most,
  not (endpoint in ('/v1/search', '/v1/artist', '/v1/album', '/v1/download', '/v1/probe', '/v1/license') or (plan <> 'free' and endpoint = '/v1/similar')) as forbidden from j),
q as (select *, row_number() over (partition by workspace_id, win order by ts, request_id) as i from p),
g as (select request_id, workspace_id, win, i, forbidden, plan, most, units, 0::bigint as used from q where i = 1
  union all select q.request_id, q.workspace_id, q.win, q.i, q.forbidden, q.plan, q.most, q.units, g.used + case when not g.forbidden and (g.plan <> 'free' or g.used + g.units <= g.most) then g.units else 0 end
  from g join q on q.workspace_id = g.workspace_id and q.win = g.win and q.i = g.i + 1),
d as (select *, not forbidden and (plan <> 'free' or used + units <= most) as allow from g)
select request_id, workspace_id, allow, case when forbidden then 'plan_endpoint_forbidden' when not allow then 'quota_exceeded_free' end as reason, case when forbidden then 0 else used end::bigint as used, case when allow then greatest(used + units - most, 0) else 0 end::bigint as overage from d"""


def _twin() -> str:
    from slatebed.plans.inputs import USAGE_SQL, WORKSPACES_SQL

    return _GATE.format(usage=USAGE_SQL, workspaces=WORKSPACES_SQL)


@query(_twin())
def win_quota_gate(spark, sf_dir):
    """The gate over the whole log at once."""
    u = usage_of(spark, sf_dir).withColumn("units", F.expr(_DEAR))
    return quota.quota_decisions(u, workspaces_of(spark, sf_dir))


@contextmanager
def _keyed_state(spark):
    """State with timers needs the store that keeps its rows apart."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _usage_stream(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    return event_stream(spark, sf_dir).select(
        F.col("event_id").alias("request_id"), "ts", F.concat(F.lit("w"), (F.col("user_id") - F.col("user_id") % 4).cast("string")).alias("workspace_id"),
        F.when(kind == "click", "/v1/search").when(kind == "view", "/v1/similar").when(kind == "purchase", "/v1/download").otherwise(F.concat(F.lit("/v1/"), kind)).alias("endpoint"),
        F.expr(_DEAR).alias("units"), "value",
    )


@query(_twin())
def st_quota_gate(spark, sf_dir):
    """The gate over a stream, its totals in state until the window's end."""
    with _keyed_state(spark):
        return finished(quota_stream.quota_gate(_usage_stream(spark, sf_dir), workspaces_of(spark, sf_dir)), "append")


# -- the usage queue


@query("with n as (select event_id as request_id, floor(value)::int % 6 as failures from events) select request_id, case when failures <= 3 then 'log' else 'dead' end as place, (least(failures, 3) + 1)::int as attempts from n")
def st_usage_queue(spark, sf_dir):
    """A replay in which a message's value says how often storing it fails."""
    work = new_path(spark, "queue")
    jobs = UsageQueue(spark, work, lambda rows: rows.withColumn("stored", F.col("attempts") > F.floor("value").cast("int") % 6))
    jobs.run(_usage_stream(spark, sf_dir).select("request_id", "endpoint", "value"), f"{work}-state")
    place = lambda name: jobs.table(name).select("request_id", F.lit(name).alias("place"), "attempts")
    return place("log").union(place("dead"))


# -- tables of upserts


@query("""with d as (select sha256(coalesce(text, '')) as sha256, lang as mime, octet_length(encode(coalesce(text, '')))::bigint as bytes, source || '/' || doc_id as source_url, doc_id as ts from documents)
select sha256, arg_min(mime, struct_pack(a := ts, b := source_url)) as mime, any_value(bytes) as bytes, arg_min(source_url, struct_pack(a := ts, b := source_url)) as source_url, min(ts) as first_seen, max(ts) as last_hit, count(*) as hit_count from d group by sha256""")
def snk_upsert_cache_index(spark, sf_dir):
    """Downloads in three batches by language, one of them delivered twice, into one index."""
    d = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = d.select(F.sha2(text, 256).alias("sha256"), F.col("lang").alias("mime"), F.octet_length(text).cast("long").alias("bytes"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_url"), F.col("doc_id").alias("ts"))
    index = upserts.cache_index(spark, new_path(spark, "index"))
    for batch, part in (("a", "mime = 'en'"), ("b", "mime in ('fr', 'de')"), ("c", "mime is null or mime not in ('en', 'fr', 'de')"), ("b", "mime in ('fr', 'de')")):
        index.upsert(upserts.hits(rows.where(part), batch))
    return index.read().select("sha256", "mime", "bytes", "source_url", "first_seen", "last_hit", upserts.hit_count().alias("hit_count"))


_SUBSCRIBED = """e as (select 'w' || (o_custkey - 1)::varchar as workspace_id, o_orderdate as updated_at, o_orderkey as event_id, case o_orderpriority when '1-URGENT' then 'team' when '5-LOW' then 'free' else 'pro' end as plan, case o_orderstatus when 'F' then 'canceled' else 'active' end as status from orders),
s as (select workspace_id, arg_max(plan, struct_pack(a := updated_at, b := event_id)) as plan, arg_max(status, struct_pack(a := updated_at, b := event_id)) as status, arg_max(event_id, struct_pack(a := updated_at, b := event_id)) as event_id from e group by workspace_id)"""


@query(f"{U}, {_SUBSCRIBED} select w.workspace_id, coalesce(s.plan, w.plan) as plan, s.status, s.event_id, w.customer_id, s.plan as subscribed from w left join s on w.workspace_id = s.workspace_id")
def snk_upsert_subscription(spark, sf_dir):
    """Orders as subscription events in two batches, the newer ones first; workspaces mirror what the newest says."""
    events = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("w"), (F.col("o_custkey") - 1).cast("string")).alias("workspace_id"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("event_id"), F.concat(F.lit("cus"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "team").when(F.col("o_orderpriority") == "5-LOW", "free").otherwise("pro").alias("plan"), F.when(F.col("o_orderstatus") == "F", "canceled").otherwise("active").alias("status"), F.lit(1).alias("seats"),
    )
    subs, spaces = upserts.subscriptions(spark, new_path(spark, "subscriptions")), upserts.workspaces(spark, new_path(spark, "workspaces"))
    made = F.lit("1900-01-01").cast(events.schema["updated_at"].dataType)  # before any event
    spaces.upsert(workspaces_of(spark, sf_dir).select("workspace_id", "plan", F.lit(None).cast("string").alias("status"), "customer_id", F.lit(None).cast("long").alias("event_id"), made.alias("updated_at")))
    middle = F.lit("1996-01-01").cast(events.schema["updated_at"].dataType)
    for part in (F.col("updated_at") >= middle, F.col("updated_at") < middle):
        upserts.apply_events(events.where(part), subs, spaces)
    told = subs.read().select("workspace_id", F.col("plan").alias("subscribed"))
    return spaces.read().join(told, "workspace_id", "left").select("workspace_id", "plan", "status", "event_id", "customer_id", "subscribed")


# -- retention

_AUDIT = "request_id long, workspace_id string, ts timestamp_ntz, endpoint string, props string"
_OLD = """k as (select workspace_id, timestamp '2024-04-20' - to_days(case when plan = 'enterprise' and audit_retention_days > 0 then audit_retention_days when plan = 'pro' then 180 when plan = 'free' then 90 else 365 end::int) as cutoff from w)"""


@query(f"{U}, {_OLD} select u.workspace_id, count(*) filter (cutoff is not null and ts < cutoff) as archived, count(*) filter (cutoff is null or ts >= cutoff) as remaining from u left join k on u.workspace_id = k.workspace_id group by u.workspace_id")
def st_retention_cron(spark, sf_dir):
    """The daily job over the log, run twice; what the archive and the log hold after it."""
    log, folder = new_path(spark, "audit-log"), new_path(spark, "audit-archive")
    archive.append_log(usage_of(spark, sf_dir).select("request_id", "workspace_id", "ts", "endpoint", "props"), log)
    now = F.lit("2024-04-20 00:00:00").cast("timestamp_ntz")
    for _ in range(2):
        archive.retain(spark, log, workspaces_of(spark, sf_dir), now, folder, "2024-04-20", _AUDIT)
    old = archive.archived(spark, folder, _AUDIT).select("workspace_id", F.lit(1).alias("a"), F.lit(0).alias("r"))
    new = archive.read_log(spark, log, _AUDIT).select("workspace_id", F.lit(0).alias("a"), F.lit(1).alias("r"))
    return old.union(new).groupBy("workspace_id").agg(F.sum("a").alias("archived"), F.sum("r").alias("remaining"))


@query(f"{U}, {_OLD} select request_id, u.workspace_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') as ts, case when units > 1 then endpoint end as endpoint, units > 1 as has_endpoint from u join k on u.workspace_id = k.workspace_id where ts < cutoff")
def snk_ndjson_archive(spark, sf_dir):
    """The archive's own lines: every key is there, null or not."""
    log, folder = new_path(spark, "audit-log"), new_path(spark, "audit-archive")
    u = usage_of(spark, sf_dir).withColumn("endpoint", F.when(F.col("units") > 1, F.col("endpoint")))
    archive.append_log(u.select("request_id", "workspace_id", "ts", "endpoint", "props"), log)
    limits = archive.cutoffs(workspaces_of(spark, sf_dir), F.lit("2024-04-20 00:00:00").cast("timestamp_ntz"))
    archive.archive_old(archive.read_log(spark, log, _AUDIT), limits, folder, "2024-04-20", _AUDIT)
    line = F.col("value")
    field = lambda n: F.get_json_object(line, f"$.{n}")
    lines = spark.read.text(folder).where(line.contains('"endpoint":') & line.contains('"props":'))
    return lines.select(field("request_id").cast("long").alias("request_id"), field("workspace_id").alias("workspace_id"), F.substring(field("ts"), 1, 23).alias("ts"), field("endpoint").alias("endpoint"), (~line.contains('"endpoint":null')).alias("has_endpoint"))
