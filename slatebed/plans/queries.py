"""Named queries over the supplied tables and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatebed.dims import CONTEXT_SAFE, OPEN, PROVIDERS
from slatebed.functions import license as lic
from slatebed.functions import urls, values
from slatebed.operators import candidates as ops
from slatebed.operators import extract, hashes, sinks, usage
from slatebed.plans import landing
from slatebed.plans.inputs import (
    CANDIDATES_SQL,
    USAGE_SQL,
    WORKSPACES_SQL,
    candidates,
    hashes_of_embeddings,
    read,
)
from slatebed.plans.inputs import usage as usage_of
from slatebed.plans.inputs import workspaces as workspaces_of
from slatebed.sources import providers
from slatebed.sources.shared import new_path, written
from slatebed.streaming import usage as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL twin."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _tags(tags: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in tags)


C = f"with c as ({CANDIDATES_SQL})"
U = f"with u as ({USAGE_SQL}), w as ({WORKSPACES_SQL})"
RANK = "case license when 'CC0' then 1 when 'PUBLIC_DOMAIN' then 2 when 'CC_BY' then 3 when 'CC_BY_SA' then 4 when 'EDITORIAL_LICENSED' then 5 when 'PRESS_KIT_ALLOWLIST' then 6 else 99 end"
ORDER = f"""{RANK}, coalesce(confidence, case when license <> 'UNKNOWN' then 0.5 else 0 end) desc,
  coalesce(width, 0)::bigint * coalesce(height, 0) desc,
  (coalesce(author, '') <> '')::int + (coalesce(source_page_url, '') <> '')::int + (coalesce(title, '') <> '')::int desc, ordinal"""
NORMAL = """case when regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') then
  lower(regexp_extract(url, '^([^:]*)', 1)) || '://' || regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^/]*//([^/?#]*)', 1)), '^.*@', ''), case lower(regexp_extract(url, '^([^:]*)', 1)) when 'https' then ':443$' when 'http' then ':80$' else ':$' end, '') || regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) ||
  coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(w|h|fit|auto|q|fm|dpr|crop|s|t)(=|$)')), '&'), ''), '')
  else url end"""
COERCE = """case when {s} = 'cc0' or contains({s}, 'public domain dedication') or contains({s}, 'publicdomain/zero') then 'CC0'
  when contains({s}, 'public domain') or {s} = 'pd' or contains({s}, 'pdm') then 'PUBLIC_DOMAIN'
  when contains({s}, 'by-sa') or contains({s}, 'by sa') or contains({s}, 'sharealike') then 'CC_BY_SA'
  when contains({s}, 'cc-by') or contains({s}, 'cc by') or {s} = 'ccby' or regexp_matches({s}, '\\bby\\b') then 'CC_BY'
  when contains({s}, 'editorial') or contains({s}, 'spotify') or contains({s}, 'caa') or contains({s}, 'itunes') then 'EDITORIAL_LICENSED'
  when contains({s}, 'press') or contains({s}, 'promo') then 'PRESS_KIT_ALLOWLIST' else 'UNKNOWN' end""".replace("{s}", "lower(trim(text))")


# -- filters and ranks of candidates


@query(f"{C} select ordinal, license from c where license in ({_tags(OPEN)})")
def flt_policy_open_only(spark, sf_dir):
    return ops.policy_filter(candidates(spark, sf_dir), "open-only").select("ordinal", "license")


@query(f"{C} select ordinal, license from c where license in ({_tags(CONTEXT_SAFE)})")
def flt_policy_context_safe(spark, sf_dir):
    return ops.policy_filter(candidates(spark, sf_dir), "safe-only").select("ordinal", "license")


@query(f"{C} select ordinal, width, height from c where not (coalesce(width, 0) > 0 and width < 800) and not (coalesce(height, 0) > 0 and height < 300)")
def flt_min_dims(spark, sf_dir):
    return ops.minimum_size(candidates(spark, sf_dir), 800, 300).select("ordinal", "width", "height")


@query(f"{C}, r as (select *, row_number() over (partition by query order by {ORDER}) as position from c where license <> 'UNKNOWN') select query, ordinal, position, 1.0::double / position as score from r")
def win_rank_all(spark, sf_dir):
    return ops.rank_all(candidates(spark, sf_dir)).select("query", "ordinal", "position", "score")


@query(f"{C}, r as (select *, row_number() over (partition by query order by case when license = 'UNKNOWN' then 1 else 0 end, {ORDER}) as position from c) select query, ordinal, position from r")
def win_rank_prefer_safe(spark, sf_dir):
    return ops.rank_all(candidates(spark, sf_dir), "prefer-safe").select("query", "ordinal", "position")


@query(f"{C}, r as (select *, row_number() over (partition by query order by {ORDER}) as position from c where license <> 'UNKNOWN') select query, ordinal, license from r where position = 1")
def win_pick_best(spark, sf_dir):
    return ops.pick_best(candidates(spark, sf_dir)).select("query", "ordinal", "license")


@query(f"{C}, r as (select *, row_number() over (partition by query, source order by ordinal) as p from c) select query, source, ordinal from r where p <= 2")
def win_max_per_provider(spark, sf_dir):
    return ops.limit_per_source(candidates(spark, sf_dir), 2).select("query", "source", "ordinal")


@query(f"{C}, r as (select *, row_number() over (partition by query, {NORMAL} order by ordinal) as p from c) select query, ordinal, url from r where p = 1")
def set_dedupe_url(spark, sf_dir):
    return ops.dedupe_url(candidates(spark, sf_dir)).select("query", "ordinal", "url")


@query(f"{C}, r as (select *, row_number() over (partition by query, {NORMAL} order by {ORDER}) as p from c) select query, ordinal, url from r where p = 1")
def set_dedupe_url_best_copy(spark, sf_dir):
    return ops.dedupe_url(candidates(spark, sf_dir), best_copy=True).select("query", "ordinal", "url")


@query(f"{C} select ordinal, {NORMAL} as normal_url from c")
def fn_normalize_url(spark, sf_dir):
    return candidates(spark, sf_dir).select("ordinal", urls.normalize_url(F.col("url")).alias("normal_url"))


@query(f"{C} select ordinal, source, url, title from c union all select page_id, 'pages', url, null from pages")
def set_union_all(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), F.lit("pages").alias("source"), "url")
    return ops.union_candidates([candidates(spark, sf_dir), p]).select("ordinal", "source", "url", "title")


@query(f"{C} select query, url, ordinal from c where (query, url) not in (select query, url from c where width < 2000)")
def set_diff(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return ops.new_since(c, c.where("width < 2000")).select("query", "url", "ordinal")


@query(f"""{C} select ordinal,
  case when coalesce(title, '') <> '' then '"' || title || '"' || coalesce(' by ' || nullif(author, ''), '') when coalesce(author, '') <> '' then 'Photo by ' || author else 'Photo' end
  || ' (' || source || '), licensed ' || case license when 'CC0' then 'CC0 / Public Domain Dedication' when 'PUBLIC_DOMAIN' then 'Public Domain' when 'CC_BY' then 'CC BY 4.0' when 'CC_BY_SA' then 'CC BY-SA 4.0' when 'EDITORIAL_LICENSED' then 'Editorial Use (platform-licensed)' when 'PRESS_KIT_ALLOWLIST' then 'Official Press Kit' else 'Unknown (rejected)' end || ' — ' || source_page_url as attribution_line from c""")
def fn_attribution(spark, sf_dir):
    return ops.enrich(candidates(spark, sf_dir)).select("ordinal", "attribution_line")


@query(f"{C}, s as (select distinct source from c) select r.source, count(c.ordinal) as n, count(c.ordinal) > 0 as ok from (select source from s union all select 'nowhere') r left join c on r.source = c.source group by r.source")
def agg_provider_report(spark, sf_dir):
    c = candidates(spark, sf_dir)
    asked = c.select("source").distinct().union(spark.sql("select 'nowhere'"))
    return ops.provider_report(c, asked)


@query(f"{C}, r as (select *, row_number() over (partition by query order by {ORDER}) as p from c where license <> 'UNKNOWN'), q as (select distinct query from c union all select 'none') select q.query, count(r.ordinal) as n, min(case when p = 1 then url end) as top_url from q left join r on q.query = r.query group by q.query")
def agg_batch_top1(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return ops.batch_top(c, c.select("query").distinct().union(spark.sql("select 'none'")))


@query(f"{C} select count(distinct source) as n_sources from c")
def agg_distinct_sources(spark, sf_dir):
    return candidates(spark, sf_dir).agg(F.count_distinct("source").alias("n_sources"))


@query(f"{C} select ordinal, coalesce(width, 0) as width from c order by coalesce(width, 0) desc, ordinal limit 50")
def srt_dynamic(spark, sf_dir):
    w = F.coalesce("width", F.lit(0))
    return candidates(spark, sf_dir).select("ordinal", w.alias("width")).orderBy(F.desc("width"), "ordinal").limit(50)


# -- license and URL functions


@query(f"select doc_id, {COERCE} as license from documents")
def fn_coerce_license(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", lic.coerce_license(F.col("text")).alias("license"))


@query(r"select doc_id, regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b|\b\d{16}\b|@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}') as personal from documents")
def flt_pii(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", values.looks_personal(F.col("text")).alias("personal"))


# -- hashes


_MEDIAN = """m as (select vec_id, list_transform(embedding, lambda x: case when x > list_sort(embedding)[33] then 1 else 0 end) as b from embeddings),
h as (select vec_id, array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef', 1 + 8*b[i*4+1] + 4*b[i*4+2] + 2*b[i*4+3] + b[i*4+4], 1)), '') as phash from m)"""


@query(f"with {_MEDIAN} select vec_id, phash from h")
def fn_median_bits(spark, sf_dir):
    return hashes_of_embeddings(spark, sf_dir).select(F.col("ordinal").alias("vec_id"), "phash")


# 64 windows of a text's bytes, as floor(place * 64 / length), each against the mean of all
_AVERAGE = """b as (select doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as l from documents),
v as (select doc_id, len(l) as n, unnest(l) as x, unnest(range(0, len(l))) as i from b),
s as (select doc_id, i * 64 // n as win, n, sum(('0x' || x)::int) as s, count(*) as c from v group by all),
t as (select *, sum(s) over (partition by doc_id) as total from s),
m as (select doc_id, map(list(win), list((s * n > total * c)::int)) as bits from t group by doc_id),
h as (select b.doc_id, array_to_string(list_transform(range(0, 16), lambda k: substr('0123456789abcdef', 1 + 8 * coalesce(bits[k * 4], 0) + 4 * coalesce(bits[k * 4 + 1], 0) + 2 * coalesce(bits[k * 4 + 2], 0) + coalesce(bits[k * 4 + 3], 0), 1)), '') as phash from b left join m on b.doc_id = m.doc_id)"""


@query(f"with {_AVERAGE}, d as (select phash, min(doc_id) as doc_id from h group by phash), n as (select doc_id, phash, ('0x' || substr(phash, 1, 8))::bigint as hi, ('0x' || substr(phash, 9, 8))::bigint as lo from d), p as (select a.doc_id as doc_a, b.doc_id as doc_b, a.phash as hash_a, b.phash as hash_b, cast(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) as int) as distance from n a join n b on a.phash < b.phash) select * from p where distance <= 5 union all select d.doc_id, h.doc_id, d.phash, h.phash, 0 from h join d on h.phash = d.phash where h.doc_id > d.doc_id")
def jn_hamming_pairs(spark, sf_dir):
    """Documents of equal hashes are linked to the first of them, the first ones of near hashes to each other."""
    h = fn_ahash_bytes(spark, sf_dir).withColumnRenamed("doc_id", "ordinal")
    return hashes.hamming_links(h, 5).withColumnsRenamed({"a": "doc_a", "b": "doc_b"})


@query(f"with {_MEDIAN}, n as (select vec_id, phash, lag(phash) over (order by vec_id) as other from h) select vec_id, cast(bit_count(xor(('0x' || substr(phash, 1, 8))::bigint, ('0x' || substr(other, 1, 8))::bigint)) + bit_count(xor(('0x' || substr(phash, 9, 8))::bigint, ('0x' || substr(other, 9, 8))::bigint)) as int) as distance from n where other is not null")
def fn_hamming(spark, sf_dir):
    h = hashes_of_embeddings(spark, sf_dir)
    other = h.select((F.col("ordinal") + 1).alias("ordinal"), F.col("phash").alias("other"))
    return h.join(other, "ordinal").select(F.col("ordinal").alias("vec_id"), values.hamming(F.col("phash"), F.col("other")).alias("distance"))


@query(f"with {_AVERAGE} select doc_id, phash from h")
def fn_ahash_bytes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", values.average_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("phash"))


#: The rule as it is told: one hash after another, against those that are kept.
_GREEDY = f"""with recursive {_AVERAGE}, f as (select phash, min(doc_id) as ordinal from h group by phash),
o as (select row_number() over (order by ordinal) as i, ordinal, phash, ('0x' || substr(phash, 1, 8))::bigint as hi, ('0x' || substr(phash, 9, 8))::bigint as lo from f),
g as (select 0::bigint as i, [{{'hi': -1::bigint, 'lo': -1::bigint}}][2:] as kept, true as own union all
  select i, case when own then list_append(kept, {{'hi': hi, 'lo': lo}}) else kept end, own
  from (select o.i, kept, hi, lo, len(list_filter(kept, lambda k: bit_count(xor(k.hi, hi)) + bit_count(xor(k.lo, lo)) <= 6)) = 0 as own from g join o on o.i = g.i + 1))
select ordinal, phash from o join g using (i) where own"""


@query(_GREEDY)
def set_dedupe_hash(spark, sf_dir):
    from slatebed.operators.hashes import greedy_dedupe

    rows = written(fn_ahash_bytes(spark, sf_dir).withColumnRenamed("doc_id", "ordinal"), "hashes")
    return greedy_dedupe(rows, 6, checkpoint=lambda d: written(d, "dedupe")).select("ordinal", "phash")


@query("with h as (select sha256(text) as sha256, doc_id from documents) select sha256, min(doc_id) as first_seen, max(doc_id) as last_hit, count(*) as hit_count from h group by sha256")
def agg_cache_index(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("doc_id").alias("ordinal"))
    return usage.blob_index(d)


# -- usage


def _gate(key: str, unit: str, most: int) -> str:
    return f"{U}, r as (select *, row_number() over (partition by {key}, date_trunc('{unit}', ts) order by ts, request_id) as p from u) select request_id, p <= {most} as admitted from r"


@query(_gate("api_key", "minute", 1))
def win_rate_limit(spark, sf_dir):
    u = usage_of(spark, sf_dir)
    return usage.admitted(u, ["api_key"], usage.minute_of(F.col("ts")), 1).select("request_id", "admitted")


@query(_gate("workspace_id", "minute", 1))
def win_pool_limit(spark, sf_dir):
    u = usage_of(spark, sf_dir)
    return usage.admitted(u, ["workspace_id"], usage.minute_of(F.col("ts")), 1).select("request_id", "admitted")


@query(_gate("workspace_id", "day", 3))
def win_daily_cap(spark, sf_dir):
    u = usage_of(spark, sf_dir)
    return usage.admitted(u, ["workspace_id"], F.date_trunc("day", "ts"), 3).select("request_id", "admitted")


@query(f"{U} select workspace_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as window_start, sum(units)::bigint as used from u group by all")
def agg_usage_window_daily(spark, sf_dir):
    return usage.usage_by_window(usage_of(spark, sf_dir), "day").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query(f"{U} select workspace_id, strftime(date_trunc('month', ts), '%Y-%m-%d') as window_start, sum(units)::bigint as used from u group by all")
def agg_usage_window_monthly(spark, sf_dir):
    return usage.usage_by_window(usage_of(spark, sf_dir), "month").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


_PLANS = "p as (select * from (values ('free', 0, 100, 0), ('pro', 1900, 10000, 1500), ('team', 7900, 50000, 1000), ('enterprise', 0, 1000000, 0)) t(plan, base_cents, included, mc))"
_SNAPSHOT = f"""n as (select max(ts) as now from u),
d as (select w.workspace_id, coalesce(p.plan, 'free') as plan, case when p.plan in ('pro', 'team', 'enterprise') then date_trunc('month', now) else date_trunc('day', now) end as window_start,
  case when p.plan in ('pro', 'team', 'enterprise') then date_trunc('month', now) + interval 1 month else date_trunc('day', now) + interval 1 day end as window_end from w left join p on w.plan = p.plan, n),
s as (select d.workspace_id, d.plan, d.window_start, d.window_end, coalesce(sum(u.units), 0)::bigint as used from d left join u on u.workspace_id = d.workspace_id and u.ts >= window_start and u.ts < window_end group by all),
o as (select s.*, p.base_cents::bigint as base_cents, p.included::bigint as included, mc, case when s.plan in ('pro', 'team') then greatest(used - p.included, 0) else 0 end::bigint as overage_units from s join p on s.plan = p.plan)"""


@query(f"{U}, {_PLANS}, {_SNAPSHOT} select workspace_id, plan, strftime(window_start, '%Y-%m-%d') as window_start, strftime(window_end, '%Y-%m-%d') as window_end, used, included, greatest(used - included, 0)::bigint as overage, base_cents, overage_units, floor((overage_units * mc + 500) / 1000)::bigint as overage_cents, base_cents + floor((overage_units * mc + 500) / 1000)::bigint as total_cents from o")
def agg_usage_snapshot(spark, sf_dir):
    """Every workspace in its plan's window as of the log's last request."""
    u = usage_of(spark, sf_dir)
    s = usage.usage_snapshot(u, workspaces_of(spark, sf_dir), usage.last_time(u))
    return s.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("window_start", "window_end")})


@query("select c_custkey, case when seg in ('pro', 'team') then greatest(u - inc, 0) else 0 end::bigint as overage_units, floor((case when seg in ('pro', 'team') then greatest(u - inc, 0) else 0 end * mc + 500) / 1000)::bigint as overage_cents from (select c_custkey, c_custkey * 37 as u, (['free', 'pro', 'team', 'enterprise'])[c_custkey % 4 + 1] as seg, ([100, 10000, 50000, 1000000])[c_custkey % 4 + 1] as inc, ([0, 1500, 1000, 0])[c_custkey % 4 + 1] as mc from customer)")
def fn_project_cost(spark, sf_dir):
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("c_custkey") % 4 + 1).cast("int"))
    cost = values.project_cost(pick("free", "pro", "team", "enterprise"), F.col("c_custkey") * 37, F.lit(0), pick(100, 10000, 50000, 1000000), pick(0, 1500, 1000, 0))
    return read(spark, sf_dir, "customer").select("c_custkey", cost["overage_units"].alias("overage_units"), cost["overage_cents"].alias("overage_cents"))


_DAILY = "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as fetches, round(count(*) * 0.012::double, 6) as cost_usd from u group by all"


@query(f"{U} {_DAILY}")
def agg_daily_series(spark, sf_dir):
    return usage.daily_series(usage_of(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"{U} select endpoint, count(*) as requests, sum(units)::bigint as units from u group by endpoint")
def agg_per_endpoint(spark, sf_dir):
    return usage_of(spark, sf_dir).groupBy("endpoint").agg(F.count("*").alias("requests"), F.sum("units").alias("units"))


@query(f"{U}, d as ({_DAILY}), b as (select *, row_number() over (order by day desc) as back from d), x as (select sum(fetches) filter (back <= 7) as last, coalesce(sum(fetches) filter (back between 8 and 14), 0) as before, sum(fetches) as total, count(*) as n, (select day from d order by fetches desc, day limit 1) as peak from b) select total::bigint as total, floor(total / n + 0.5)::bigint as avg_per_day, peak as peak_day, round((last - before) / (case when before = 0 then 1 else before end) * 100, 6) as delta_pct from x")
def agg_dashboard(spark, sf_dir):
    return usage.dashboard_numbers(usage.daily_series(usage_of(spark, sf_dir))).withColumn("peak_day", F.date_format("peak_day", "yyyy-MM-dd"))


@query(f"{U}, k as (select workspace_id, case when plan = 'enterprise' and audit_retention_days > 0 then audit_retention_days when plan = 'pro' then 180 when plan = 'free' then 90 else 365 end as keep_days from w) select request_id, u.workspace_id from u join k on u.workspace_id = k.workspace_id where u.ts < timestamp '2024-04-20' - to_days(keep_days::int)")
def jn_retention(spark, sf_dir):
    now = F.lit("2024-04-20 00:00:00").cast("timestamp_ntz")
    return usage.expired(usage_of(spark, sf_dir), workspaces_of(spark, sf_dir), now).select("request_id", "workspace_id")


@query("select c_custkey, case when plan = 'enterprise' and over > 0 then over when plan = 'free' then 90 when plan = 'pro' then 180 else 365 end::int as days from (select c_custkey, (['free', 'pro', 'team', 'enterprise', 'trial', null])[c_custkey % 6 + 1] as plan, case when c_acctbal > 0 then floor(c_acctbal / 100)::int - 20 end as over from customer)")
def fn_retention_days(spark, sf_dir):
    plan = F.element_at(F.array(*map(F.lit, ("free", "pro", "team", "enterprise", "trial", None))), (F.col("c_custkey") % 6 + 1).cast("int"))
    own = F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 100).cast("int") - 20)
    return read(spark, sf_dir, "customer").select("c_custkey", values.retention_days(plan, own).alias("days"))


@query("select event_id, (n * case u when 's' then 1000 when 'm' then 60000 when 'h' then 3600000 when 'd' then 86400000 end)::bigint as ms from (select event_id, event_id % 90 as n, (['s', 'm', 'h', 'd', 'x'])[event_id % 5 + 1] as u from events)")
def fn_parse_interval(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, "smhdx")), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", values.parse_interval(F.concat((F.col("event_id") % 90).cast("string"), unit)).alias("ms"))


@query(f"{U} select request_id, endpoint from u order by ts desc, request_id desc limit 100")
def lim_recent(spark, sf_dir):
    return usage_of(spark, sf_dir).orderBy(F.desc("ts"), F.desc("request_id")).limit(100).select("request_id", "endpoint")


@query(f"{U} select endpoint, min(request_id) as first_request from u group by endpoint")
def agg_distinct_actions(spark, sf_dir):
    return usage_of(spark, sf_dir).groupBy("endpoint").agg(F.min("request_id").alias("first_request"))


@query(f"{U} select count(*) filter (units = 1) as single, count(*) filter (units > 1) as heavy from u")
def agg_count_status(spark, sf_dir):
    return usage_of(spark, sf_dir).agg(F.count_if(F.col("units") == 1).alias("single"), F.count_if(F.col("units") > 1).alias("heavy"))


# -- joins over keys


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT'")
def jn_key_workspace(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.where("o_orderpriority = '1-URGENT'").join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as p from orders) select c_custkey, o_orderkey from r join customer on o_custkey = c_custkey where p = 1")
def jn_first_workspace(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    first = o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return c.join(first, c.c_custkey == first.o_custkey).select("c_custkey", "o_orderkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'O')")
def jn_semi_role(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return c.join(o.where("o_orderstatus = 'O'"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("select distinct user_id, event_type from events where ts >= timestamp '2024-01-04' and (user_id, event_type) not in (select user_id, event_type from events where ts < timestamp '2024-01-04')")
def jn_anti_watch(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    cut = F.lit("2024-01-04").cast("timestamp_ntz")
    return e.where(F.col("ts") >= cut).select("user_id", "event_type").distinct().join(e.where(F.col("ts") < cut).select("user_id", "event_type").distinct(), ["user_id", "event_type"], "left_anti")


# -- pages and documents


@query("""select page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*?\\bhref=["'']([^"'']+)["'']', 1, 'i')) as href from pages""")
def ext_links(spark, sf_dir):
    return extract.page_links(read(spark, sf_dir, "pages")).select("page_id", "href")


@query("with d as (select doc_id, lower(substr(text, 1, 60)) as title, lower(text) as body from documents) select doc_id, (case when contains(title, 'the') then 10 else 0 end + case when len(list_filter(regexp_extract_all(title || chr(10) || body, '(?m)^#{2,3}[ \\t]+([^\\n]+)$', 1), lambda h: contains(h, 'the'))) > 0 then 5 else 0 end + 1 + case when contains(title, 'and') then 10 else 0 end + case when len(list_filter(regexp_extract_all(title || chr(10) || body, '(?m)^#{2,3}[ \\t]+([^\\n]+)$', 1), lambda h: contains(h, 'and'))) > 0 then 5 else 0 end + 1)::int as score from d where contains(title || chr(10) || body, 'the') and contains(title || chr(10) || body, 'and') order by score desc, doc_id limit 12")
def fn_doc_score(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"))
    return extract.doc_scores(d, "the and")


@query("select conv_id, turn, text from (select *, row_number() over (partition by conv_id order by turn desc) as p from conversations) where p <= 2")
def lim_ring(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return read(spark, sf_dir, "conversations").withColumn("p", place).where("p <= 2").select("conv_id", "turn", "text")


def _source(name: str):
    def run(spark, sf_dir):
        found = providers.candidates_of(landing.responses(spark, sf_dir, name), name)
        return found.select("query", "ordinal", "url", "license", "confidence", "author", "title")

    run.__name__ = f"src_{name.replace('-', '_')}"
    return run


for _name in landing.LANDED:
    query(landing.expected(_name))(_source(_name))


@query(f"""with c as ({landing._PAGED}), p as (select *, row_number() over (partition by page order by ordinal) - 1 as place from c)
select page::varchar as query, place::bigint as ordinal, url, 'CC0' as license, title, author from p where license in ('CC0', 'PUBLIC_DOMAIN') and coalesce(width, 0) % 5 <> 0""")
def src_met_museum(spark, sf_dir):
    """Pages of ids, and each document as the object of its id."""
    c = candidates(spark, sf_dir).withColumn("page", F.floor(F.col("ordinal") / landing.PAGE).cast("string"))
    searches = c.groupBy(F.col("page").alias("query")).agg(F.to_json(F.struct(F.count("*").alias("total"), F.array_sort(F.collect_list("ordinal")).alias("objectIDs"))).alias("body"))
    details = c.select(
        F.to_json(
            F.struct(
                F.col("ordinal").alias("objectID"), F.col("license").isin("CC0", "PUBLIC_DOMAIN").alias("isPublicDomain"), F.when(F.coalesce("width", F.lit(0)) % 5 == 0, "").otherwise(F.col("url")).alias("primaryImage"), "title", F.col("author").alias("artistDisplayName")
            )
        ).alias("body")
    )
    return providers.museum_candidates(searches, details).select("query", "ordinal", "url", "license", "title", "author")


@query("select 'https://i.ytimg.com/vi/abcdefghij' || (user_id % 10)::varchar || '/' || n || '.jpg' as url, count(*) as n from events, (values ('maxresdefault'), ('sddefault'), ('hqdefault')) v(n) group by 1")
def src_youtube_thumb(spark, sf_dir):
    q = read(spark, sf_dir, "events").select(F.concat(F.lit("abcdefghij"), (F.col("user_id") % 10).cast("string")).alias("query"))
    return providers.video_thumbnails(q).groupBy("url").agg(F.count("*").alias("n"))


_ALL = ", ".join(f"('{row[0]}', {str(row[2]).lower()})" for row in PROVIDERS)


@query(f"""with p as (select * from (values {_ALL}) t(source, is_default)), i as (select source, row_number() over (order by source) - 1 as i from p), n as (select doc_id % {len(PROVIDERS)} as i, count(*) as n from documents where lang <> 'es' group by 1)
select p.source, coalesce(n, 0) as n from p join i using (source) left join n on n.i = i.i where is_default""")
def src_registry(spark, sf_dir):
    """The sources asked when none is named, each with what was found of it, none included."""
    from slatebed.dims import provider_dim

    names = F.array(*(F.lit(x) for x in sorted(row[0] for row in PROVIDERS)))
    found = read(spark, sf_dir, "documents").where("lang <> 'es'").groupBy(F.element_at(names, (F.col("doc_id") % len(PROVIDERS) + 1).cast("int")).alias("source")).agg(F.count("*").alias("n"))
    return provider_dim(spark).where("is_default").join(found, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


@query()
def fn_dct_phash(spark, sf_dir):
    wide = F.flatten(F.array_repeat("embedding", 16))
    return read(spark, sf_dir, "embeddings").select("vec_id", values.dct_hash(wide).alias("phash"))


@query("select doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(strip_accents(substr(coalesce(text, ''), 1, 60))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), ''), 'image') as slug from documents")
def fn_slug_filename(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", values.slug(F.substring(F.coalesce("text", F.lit("")), 1, 60)).alias("slug"))


@query("select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&apos;') as escaped from documents")
def fn_xmp_escape(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", values.xml_escape(F.col("text")).alias("escaped"))


@query("select doc_id, case when length(text) > 40 then substr(text, 1, 39) || '…' else text end as cell from documents")
def prj_truncate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", values.truncate(F.col("text"), 40).alias("cell"))


@query("select doc_id, substr(sha256(doc_id::varchar), 1, 16) as watch_key from documents")
def fn_watch_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 16).alias("watch_key"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _replayed(spark: SparkSession, sf_dir: str, make, mode: str) -> DataFrame:
    """Runs a stream over the events table to its end and returns what it has written."""
    kind = F.col("event_type")
    rows = event_stream(spark, sf_dir).select(F.col("event_id").alias("request_id"), "ts", F.concat(F.lit("/v1/"), kind).alias("endpoint"), F.when(kind == "purchase", 2).when(kind == "view", 3).otherwise(1).alias("units"))
    return finished(make(rows), mode)


def finished(out: DataFrame, mode: str) -> DataFrame:
    """What a stream writes until its source has no more."""
    spark = out.sparkSession
    path = new_path(spark, "replay")
    written = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")
        written.append(number)

    job = out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    job.awaitTermination()
    if not written:
        return spark.createDataFrame([], out.schema)
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, '/v1/' || event_type as endpoint, count(*) as requests, sum(case event_type when 'purchase' then 2 when 'view' then 3 else 1 end)::bigint as units from events group by all")
def st_usage_stream(spark, sf_dir):
    done = _replayed(spark, sf_dir, streams.units_by_window, "complete")
    return done.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "endpoint", "requests", "units")


@query("select count(*) as n from (select distinct event_id from events)")
def st_dedupe_request(spark, sf_dir):
    return _replayed(spark, sf_dir, lambda rows: streams.deduplicated(rows.union(rows)), "append").agg(F.count("*").alias("n"))


# -- extractors, buckets and sinks that came later


@query()
def fn_token_bucket(spark, sf_dir):
    return usage.token_bucket(usage_of(spark, sf_dir), 2.0, 1 / 86400).select("request_id", "allowed")


@query(f"{C}, r as (select *, row_number() over (partition by query order by {ORDER}) as position from c where license <> 'UNKNOWN') select query, lpad(position::varchar, greatest(3, length(position::varchar))::int, '0') || '.jpg' as file, position from r")
def snk_manifest(spark, sf_dir):
    return sinks.manifest(ops.rank_all(candidates(spark, sf_dir))).select("query", "file", "position")


@query(f"{C} select ordinal, '![' || coalesce(title, 'image') || '](' || url || ')' as line from c")
def snk_markdown(spark, sf_dir):
    none = F.lit(None).cast("string")
    return candidates(spark, sf_dir).select("ordinal", sinks.markdown_image(F.col("title"), F.col("url"), none).alias("line"))


@query(f"{U} select api_key, arg_max(request_id, struct_pack(ts := ts, id := request_id)) as request_id from u group by api_key")
def snk_latest_by_key(spark, sf_dir):
    return sinks.latest_by(usage_of(spark, sf_dir), "api_key", ["ts", "request_id"]).select("api_key", "request_id")


from slatebed.plans import more, pages, search, small, state  # noqa: E402, F401  further queries
