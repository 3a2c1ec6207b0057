"""Named queries of the audit, billing, page and small operators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatebed.functions import license as lic
from slatebed.functions import urls, values
from slatebed.operators import audit, billing, extract, sinks, sites, usage
from slatebed.operators import candidates as ops
from slatebed.operators.totals import numbered
from slatebed.plans.inputs import candidates, read
from slatebed.plans.inputs import usage as usage_of
from slatebed.plans.inputs import workspaces as workspaces_of
from slatebed.plans.queries import _AVERAGE, _DAILY, _PLANS, _SNAPSHOT, NORMAL, ORDER, RANK, C, U, fn_ahash_bytes, query
from slatebed.sources.shared import new_path, written
from slatebed.streaming import usage as streams

# -- filters


@query("select doc_id from documents where trim(coalesce(text, ''), ' \n\t\r') <> ''")
def flt_blank_query(spark, sf_dir):
    """Blank queries give nothing."""
    return read(spark, sf_dir, "documents").where(F.coalesce("text", F.lit("")).rlike(r"[^ \n\t\r]")).select("doc_id")


@query("select doc_id, case when lang not in ('en', 'fr') then 'bad-type' when octet_length(encode(coalesce(text, ''))) > 2000 then 'too-large' end as error_kind from documents")
def flt_content_type(spark, sf_dir):
    mime = F.when(F.col("lang").isin("en", "fr"), F.concat(F.lit("image/"), F.col("lang"), F.lit("; q=1"))).otherwise("text/html")
    kind = values.download_error(mime, F.octet_length(F.coalesce("text", F.lit(""))), 2000)
    return read(spark, sf_dir, "documents").select("doc_id", kind.alias("error_kind"))


@query("select c_custkey from customer where contains(lower(c_name), '#0000') or contains(lower(c_mktsegment), 'build')")
def flt_key_search(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.where(F.lower("c_name").contains("#0000") | F.lower("c_mktsegment").contains("build")).select("c_custkey")


@query(f"{U} select request_id from u where units = 1 and (contains(endpoint, 'search') or contains(request_id::varchar, '77'))")
def flt_audit_usage(spark, sf_dir):
    u = usage_of(spark, sf_dir).withColumn("id", F.col("request_id").cast("string"))
    return u.where((F.col("units") == 1) & (audit.contains_any("search", "endpoint") | audit.contains_any("77", "id"))).select("request_id")


@query(f"{U} select request_id from u where endpoint = '/v1/download' and (contains(endpoint, '9') or contains(api_key, '9'))")
def flt_audit_action(spark, sf_dir):
    u = usage_of(spark, sf_dir).where("endpoint = '/v1/download'")
    return u.where(audit.contains_any("9", "endpoint", "api_key")).select("request_id")


@query(f"{U} select workspace_id from w where audit_retention_days is null")
def flt_not_null(spark, sf_dir):
    return workspaces_of(spark, sf_dir).where(F.col("audit_retention_days").isNull()).select("workspace_id")


@query(f"{U} select request_id from u where workspace_id = 'w4' and ts between timestamp '2024-01-05' and timestamp '2024-01-20'")
def flt_time_range(spark, sf_dir):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return audit.between(usage_of(spark, sf_dir), F.col("workspace_id") == "w4", at("2024-01-05"), at("2024-01-20")).select("request_id")


@query(f"{U}, d as ({_DAILY}) select day, fetches from d qualify row_number() over (order by day desc) <= 7")
def flt_range_days(spark, sf_dir):
    last = audit.latest_points(usage.daily_series(usage_of(spark, sf_dir)), 7)
    return last.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "fetches")


@query(f"{U} select request_id from u where endpoint = '/v1/similar'")
def flt_endpoint(spark, sf_dir):
    return usage_of(spark, sf_dir).where("endpoint = '/v1/similar'").select("request_id")


_ROLE = "(['owner', 'admin', 'member', 'billing', 'viewer'])[c_custkey % 5 + 1]"


@query(f"select c_custkey, {_ROLE} in ('owner', 'admin') as members, {_ROLE} in ('owner', 'admin', 'billing') as pays, {_ROLE} in ('owner', 'admin', 'member') as makes_keys from customer")
def flt_rbac(spark, sf_dir):
    role = F.element_at(F.array(*map(F.lit, ("owner", "admin", "member", "billing", "viewer"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", role.isin(*audit.MANAGERS).alias("members"), role.isin(*audit.PAYERS).alias("pays"), role.isin(*audit.MAKERS).alias("makes_keys"))


#: The events of the log under the names that may be sent; a sign-up has none.
_SENT = "case event_type when 'click' then 'search_completed' when 'view' then 'cli_invoked' when 'purchase' then 'fetch_completed' when 'error' then 'provider_error' else event_type end"


@query(f"select event_id, name from (select event_id, {_SENT} as name from events) where name in ('cli_invoked', 'search_completed', 'fetch_completed', 'provider_error', 'telemetry_enabled', 'telemetry_disabled')")
def flt_event_allowlist(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.expr(_SENT).alias("name"))
    return e.where(F.col("name").isin(*audit.EVENTS))


_SAFE = "license in ('CC0', 'PUBLIC_DOMAIN', 'CC_BY', 'CC_BY_SA', 'EDITORIAL_LICENSED', 'PRESS_KIT_ALLOWLIST')"


@query(f"{C}, p as (select unnest(['any', 'context-safe', 'open-only', 'prefer-safe', 'safe-only']) as policy) select policy, count(*) as kept, sum(ordinal)::bigint as ordinals from c, p where policy in ('any', 'prefer-safe') or (policy in ('context-safe', 'safe-only') and {_SAFE}) or license in ('CC0', 'PUBLIC_DOMAIN', 'CC_BY', 'CC_BY_SA') group by policy")
def flt_policy(spark, sf_dir):
    """What each of the policies lets through."""
    c = candidates(spark, sf_dir)
    return ops.union_candidates([ops.policy_filter(c, p).agg(F.count("*").alias("kept"), F.sum("ordinal").alias("ordinals")).select(F.lit(p).alias("policy"), "kept", "ordinals") for p in ops.POLICIES])


@query(f"{C} select ordinal, license from c")
def flt_policy_legacy(spark, sf_dir):
    """The old switch for unsafe licenses lets every row through."""
    return ops.policy_filter(candidates(spark, sf_dir), ops.resolve_policy(None, require_safe_license=False)).select("ordinal", "license")


# -- joins


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_orderpriority = '5-LOW' or o_orderkey = 7")
def jn_session_user(spark, sf_dir):
    """A session by its token or its id, with its user."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return ops.session_user(o.where("o_orderpriority = '5-LOW' or o_orderkey = 7"), c, "o_custkey", "c_custkey").select("o_orderkey", "c_name")


@query("select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def jn_members_users(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return ops.session_user(ops.session_user(c, n, "c_nationkey", "n_nationkey"), r, "n_regionkey", "r_regionkey").select("c_custkey", "n_name", "r_name")


@query("select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_orderdate desc, o_orderkey desc)::int as place from orders join customer on o_custkey = c_custkey and o_orderstatus = 'F'")
def jn_member_workspace(spark, sf_dir):
    """A user's workspaces, the newest first."""
    o, c = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), read(spark, sf_dir, "customer")
    place = F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return ops.session_user(o, c, "o_custkey", "c_custkey").select("c_custkey", "o_orderkey", place.alias("place"))


_METERED = f"{U}, m as (select u.*, w.customer_id, case when w.workspace_id is null then 'no_workspace' when w.plan not in ('pro', 'team') then 'free_tier' when w.customer_id is null then 'no_customer' end as skipped from u left join w on u.workspace_id = w.workspace_id)"


@query(f"{_METERED} select request_id, skipped from m")
def jn_usage_customer(spark, sf_dir):
    return billing.metered_usage(usage_of(spark, sf_dir), workspaces_of(spark, sf_dir)).select("request_id", "skipped")


@query(f"{_METERED} select customer_id, sum(units)::bigint as quantity from m where skipped is null group by customer_id having sum(units) > 0")
def snk_usage_flush(spark, sf_dir):
    return billing.flushed(billing.metered_usage(usage_of(spark, sf_dir), workspaces_of(spark, sf_dir)))


# -- numbers


@query(f"{U}, {_PLANS}, {_SNAPSHOT} select workspace_id, case when included = 0 then 0.0 else used / included end::double as share, case when used >= included then 'over' when used >= 0.8 * included then 'near' else 'fine' end as level from o")
def agg_quota_pct(spark, sf_dir):
    u = usage_of(spark, sf_dir)
    return usage.quota_share(usage.usage_snapshot(u, workspaces_of(spark, sf_dir), usage.last_time(u)))


@query(f"{U}, d as ({_DAILY}) select day, floor(cost_usd * 100 + 0.5)::bigint as cents from d")
def agg_cost_cents(spark, sf_dir):
    d = usage.daily_series(usage_of(spark, sf_dir))
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), values.round_half_up(F.col("cost_usd") * 100).cast("long").alias("cents"))


@query(f"with n as (select source, count(*) as n from documents group by source), r as (select coalesce(n, 0) as n from (select source from n union all select 'nowhere') x left join n using (source)) select sum(n)::bigint as candidates, count(*) filter (n > 0) as ok, count(*) as asked from r")
def agg_ok_ratio(spark, sf_dir):
    c = candidates(spark, sf_dir)
    report = ops.provider_report(c, c.select("source").distinct().union(spark.sql("select 'nowhere'")))
    return ops.ok_ratio(report)


@query("select o_custkey, case when min(case when l_linestatus = 'F' then l_linenumber end) is null then 1 else (min(struct_pack(n := l_linenumber, q := l_quantity::bigint)) filter (l_linestatus = 'F')).q + 5 end::bigint as seats from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_orderkey")
def agg_seats(spark, sf_dir):
    item = F.struct(F.col("l_linenumber"), F.when(F.col("l_linestatus") == "F", "seat").otherwise("base").alias("price_id"), F.col("l_quantity").cast("long").alias("quantity"))
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = lines.groupBy("o_custkey", "l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))  # an order has seven lines at most
    return items.select("o_custkey", billing.seats(F.transform("items", lambda i: F.struct(i["price_id"].alias("price_id"), i["quantity"].alias("quantity")))).cast("long").alias("seats"))


@query("select o_custkey, l_orderkey, case when bool_or(l_returnflag = 'R') then 'team' when bool_or(l_returnflag = 'A') then 'pro' else 'free' end as plan from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_orderkey")
def fn_provider_infer_plan(spark, sf_dir):
    name = F.when(F.col("l_returnflag") == "R", "price_team").when(F.col("l_returnflag") == "A", "price_pro").otherwise("price_x")
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("o_custkey", "l_orderkey").agg(billing.inferred_plan(F.collect_set(name)).alias("plan"))


def _number(name: str, sql: str, pick):
    def run(spark, sf_dir):
        numbers = usage.dashboard_numbers(usage.daily_series(usage_of(spark, sf_dir)))
        return numbers.select(pick(numbers))

    run.__name__ = name
    query(f"{U}, d as ({_DAILY}) {sql}")(run)


_number("agg_total_fetches", "select sum(fetches)::bigint as total from d", lambda n: n.total)
_number("agg_avg_per_day", "select floor(sum(fetches) / greatest(count(*), 1) + 0.5)::bigint as avg_per_day from d", lambda n: n.avg_per_day)
_number("agg_peak_day", "select day as peak_day from d order by fetches desc, day limit 1", lambda n: F.date_format("peak_day", "yyyy-MM-dd").alias("peak_day"))
_DELTA = ", b as (select *, row_number() over (order by day desc) as back from d), x as (select sum(fetches) filter (back <= 7) as last, coalesce(sum(fetches) filter (back between 8 and 14), 0) as before from b) select round((last - before) / (case when before = 0 then 1 else before end) * 100, 6) as delta_pct from x"
_number("agg_delta7", _DELTA, lambda n: n.delta_pct)


@query(f"{U}, d as ({_DAILY}), b as (select day, sum(fetches) over w as last, sum(fetches) over v as before from d window w as (order by day rows between 6 preceding and current row), v as (order by day rows between 13 preceding and 7 preceding)) select day, last::bigint as last, coalesce(before, 0)::bigint as before, round((last - coalesce(before, 0)) / (case when coalesce(before, 0) = 0 then 1 else before end) * 100, 6) as delta_pct from b")
def win_rolling_cmp(spark, sf_dir):
    """Seven days against the seven before, for every day of the series."""
    return usage.rolling_compare(usage.daily_series(usage_of(spark, sf_dir)), 7).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"{U}, k as (select u.*, case when w.plan in ('pro', 'team', 'enterprise') then 'month' else 'day' end as unit from u left join w on u.workspace_id = w.workspace_id) select workspace_id, unit, strftime(case unit when 'day' then date_trunc('day', ts) else date_trunc('month', ts) end, '%Y-%m-%d') as window_start, sum(units)::bigint as used from k group by all")
def agg_usage_window(spark, sf_dir):
    """Units by the window of the workspace's plan: days for free, months for others."""
    found = usage.usage_by_plan_window(usage_of(spark, sf_dir), workspaces_of(spark, sf_dir))
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


# -- sorts and limits


@query(f"{U} select request_id, row_number() over (order by ts desc, request_id desc) as place from u order by ts desc, request_id desc limit 1000")
def srt_sql(spark, sf_dir):
    """The newest rows of a log as its readers order and page them."""
    top = audit.newest(usage_of(spark, sf_dir), 1000)
    return top.select("request_id", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("request_id"))).cast("long").alias("place"))


@query(f"{U} select request_id from u order by ts desc, request_id desc limit 1000")
def lim_clamped(spark, sf_dir):
    """A limit of 5000 is held to 1000."""
    return audit.newest(usage_of(spark, sf_dir), 5000).select("request_id")


@query(f"{C}, r as (select *, row_number() over (partition by query order by {ORDER}) as position from c where license <> 'UNKNOWN') select query, ordinal from r where position <= 20")
def lim_display(spark, sf_dir):
    return ops.rank_all(candidates(spark, sf_dir)).where("position <= 20").select("query", "ordinal")


@query(f"{C} select ordinal, row_number() over (order by {ORDER}) as place from c")
def srt_multi_key(spark, sf_dir):
    """All candidates in one order of many keys; the places are numbered without one task for all."""
    return numbered(candidates(spark, sf_dir), [], ops._rank_keys("any"), "place").select("ordinal", "place")


@query(f"{U} select endpoint, count(*) as n from u group by endpoint order by n desc, endpoint limit 6")
def topk_providers(spark, sf_dir):
    return usage_of(spark, sf_dir).groupBy("endpoint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "endpoint").limit(6)


# -- sets


@query(f"{C}, a as (select query, url, ordinal from c where width < 2000), b as (select query, url, ordinal from c where width >= 1000) select query, url, min(ordinal) as ordinal from (select * from a union all select * from b) group by query, url")
def set_union_state(spark, sf_dir):
    c = candidates(spark, sf_dir).select("query", "url", "ordinal", "width")
    return billing.union_seen(c.where("width < 2000").drop("width"), c.where("width >= 1000").drop("width"))


@query(f"{C} select ordinal, coalesce(nullif(author, ''), title, 'nobody') as name from c")
def set_overlay_map(spark, sf_dir):
    """Later settings lie over earlier ones where they are not empty."""
    c = candidates(spark, sf_dir)
    return c.select("ordinal", ops.overlaid(F.lit("nobody"), F.col("title"), F.col("author")).alias("name"))


def _hashed(spark, sf_dir):
    h = fn_ahash_bytes(spark, sf_dir).select(F.col("doc_id").alias("ordinal"), "phash")
    size = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return candidates(spark, sf_dir).join(h, "ordinal").join(size, "ordinal")


_NEAR = f"""{_AVERAGE}, x as (select doc_id, phash, ('0x' || substr(phash, 1, 8))::bigint as hi, ('0x' || substr(phash, 9, 8))::bigint as lo from h)"""


@query(f"""{C}, {_NEAR}, k as (select x.*, row_number() over (order by coalesce(width, 0)::bigint * coalesce(height, 0) desc, {RANK}, coalesce(confidence, 0) desc, octet_length(encode(coalesce(text, ''))), c.ordinal) as better from c join x on c.ordinal = x.doc_id join documents t on t.doc_id = x.doc_id),
e as (select phash, any_value(hi) as hi, any_value(lo) as lo, min(better) as better, arg_min(doc_id, better) as ordinal from k group by phash)
select ordinal from e a where not exists (select 1 from e b where b.better < a.better and substr(a.phash, 1, 4) = substr(b.phash, 1, 4) and bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 5)""")
def dup_recipe(spark, sf_dir):
    """Of near copies in a bucket of the hash's top 16 bits the best, by size, license, confidence and bytes."""
    return ops.best_copies(written(_hashed(spark, sf_dir).select("ordinal", "phash", "width", "height", "license", "confidence", "bytes"), "hashed")).select("ordinal")


@query(f"with {_NEAR}, e as (select distinct phash, hi, lo from x), p as (select substr(a.phash, 1, 4) = substr(b.phash, 1, 4) as same from e a join e b on a.phash < b.phash and bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 5) select count(*) as pairs, count(*) filter (same) as found, count(*) filter (same) / nullif(count(*), 0) as recall from p")
def dup_recall(spark, sf_dir):
    """What the buckets of the recipe find of all near pairs."""
    return ops.bucket_recall(fn_ahash_bytes(spark, sf_dir))


@query(f"{C}, r as (select *, row_number() over (partition by query, {NORMAL} order by ordinal) as p from c) select query, ordinal from r where p = 1")
def win_dedupe_first(spark, sf_dir):
    """The first row of each normalised address."""
    return ops.first_by(candidates(spark, sf_dir), "query", urls.normalize_url(F.col("url"))).select("query", "ordinal")


# -- functions


@query(f"{C} select ordinal, case when coalesce(title, '') <> '' then '\"' || title || '\" ' else '' end || case when coalesce(author, '') <> '' then 'by ' || author || ' ' else '' end || '(' || license || ') — ' || source_page_url as line from c")
def fn_attribution_ide(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return c.select("ordinal", lic.short_attribution(F.col("license"), F.col("author"), F.col("source"), F.col("source_page_url"), F.col("title")).alias("line"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def fn_parse_meta(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", audit.meta_field(F.col("props"), "k").alias("k"))


@query(f"{C} select ordinal, ({RANK})::int as rank, license in ('CC0', 'PUBLIC_DOMAIN', 'CC_BY', 'CC_BY_SA') as is_open, license in ('CC_BY', 'CC_BY_SA', 'EDITORIAL_LICENSED', 'PRESS_KIT_ALLOWLIST') as credit, case license when 'PUBLIC_DOMAIN' then 'PD' when 'EDITORIAL_LICENSED' then 'EDITORIAL' when 'PRESS_KIT_ALLOWLIST' then 'PRESSKIT' else license end as short from c")
def fn_license_rank(spark, sf_dir):
    tag = F.col("license")
    return candidates(spark, sf_dir).select("ordinal", lic.license_rank(tag).alias("rank"), lic.is_open(tag).alias("is_open"), lic.requires_attribution(tag).alias("credit"), lic.short_license(tag).alias("short"))


@query(f"{C} select ordinal, case license when 'PUBLIC_DOMAIN' then 'PD' when 'EDITORIAL_LICENSED' then 'EDITORIAL' when 'PRESS_KIT_ALLOWLIST' then 'PRESSKIT' else license end as short from c")
def fn_short_license(spark, sf_dir):
    return candidates(spark, sf_dir).select("ordinal", lic.short_license(F.col("license")).alias("short"))


@query(f"{C} select ordinal, license in ('CC0', 'PUBLIC_DOMAIN', 'CC_BY', 'CC_BY_SA') as is_open from c")
def fn_is_open(spark, sf_dir):
    return candidates(spark, sf_dir).select("ordinal", lic.is_open(F.col("license")).alias("is_open"))


@query(r"select page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)), '') as host from pages")
def fn_safe_host(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"))


@query(r"select doc_id, nullif(trim(regexp_replace('<b>' || substr(text, 1, 50) || '</b><br/>', '<[^>]+>', '', 'g'), ' '), '') as plain from documents where text is not null")
def fn_strip_html(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", values.strip_html(F.concat(F.lit("<b>"), F.substring("text", 1, 50), F.lit("</b><br/>"))).alias("plain"))


@query("select c_custkey, c_name || repeat('•', 24) as masked from customer")
def fn_mask_key(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", values.mask_key(F.col("c_name")).alias("masked"))


@query("select doc_id, sha256(coalesce(text, '')) as sha256 from documents")
def fn_sha256(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))


@query("select event_id, floor(epoch_ms(ts) / 60000)::bigint as minute, strftime(ts, '%Y-%m-%d') as day from events")
def fn_minute_bucket(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", usage.minute_of_nearest_ms(F.col("ts")).alias("minute"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("select event_id, array_to_string(list_transform(range(9, -1, -1), lambda i: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', ((epoch_us(ts) // 1000 // power(32, i)::bigint) % 32 + 1)::int, 1)), '') as prefix from events")
def fn_ulid_time(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", values.ulid_time(F.unix_millis(F.col("ts").cast("timestamp"))).alias("prefix"))


@query(f"{U} select request_id, case endpoint when '/v1/download' then 2 when '/v1/similar' then 3 else 1 end as cost from u")
def fn_units_for(spark, sf_dir):
    return usage_of(spark, sf_dir).select("request_id", values.units_for(F.col("endpoint")).alias("cost"))


_PII = r"\b\d{3}-\d{2}-\d{4}\b|\b\d{16}\b|@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}"


@query(f"""with c as (select coalesce(text, '') as query, lang as source from documents), q as (select query, bool_or(coalesce(source = 'fr', false)) as browsed, bool_or(coalesce(source = 'es', false)) as dry from c group by query)
select sha256(query) as query, case when trim(query, ' ') = '' then 'empty' else array_to_string(list_filter([case when dry then 'dry-run' end, case when regexp_matches(query, '{_PII}') then 'pii' end, case when browsed and not dry then 'browser' end, case when not dry then 'any-policy' end], lambda x: x is not null), ',') end as warnings from q""")
def prj_warnings(spark, sf_dir):
    """Texts as queries: what was found in French counts as found by a browser, what is in Spanish is asked for dry."""
    c = read(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("query"), F.when(F.col("lang") == "fr", "browser").otherwise(F.col("lang")).alias("source"))
    asked = c.groupBy("query").agg(F.bool_or(F.coalesce(F.col("source") == "es", F.lit(False))).alias("dry_run"))
    told = ops.warnings_of(c, asked, "any")
    return told.select(F.sha2("query", 256).alias("query"), F.array_join("warnings", ",").alias("warnings"))


# -- pages


# -- sources and sinks


def _folder(spark) -> str:
    return new_path(spark, "more")


@query("select sha256(coalesce(text, '')) as sha256, any_value(octet_length(encode(coalesce(text, ''))))::int as size from documents group by 1")
def src_cache_read(spark, sf_dir):
    """Blobs put into the store and read back by their hashes."""
    store = _folder(spark)
    blobs = read(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    sinks.put_blobs(blobs, store)
    wanted = blobs.select(F.sha2("content", 256).alias("sha256")).distinct()
    return sinks.get_blobs(spark, store, wanted).select("sha256", F.octet_length("content").alias("size"))


@query(f"{U} select request_id, endpoint || ',' || api_key || ',' || '\"' || replace(props, '\"', '\"\"') || '\"' as line from u where endpoint = '/v1/search'")
def snk_csv_audit_ui(spark, sf_dir):
    u = usage_of(spark, sf_dir).where("endpoint = '/v1/search'")
    return u.select("request_id", audit.audit_line(F.col("endpoint"), F.col("api_key"), F.col("props")).alias("line"))


@query(f"{C} select ordinal, url as image, license, coalesce(confidence, 0)::double as sure from c")
def snk_attr_sidecar(spark, sf_dir):
    c = candidates(spark, sf_dir)
    record = sinks.provenance(F.col("url"), F.col("source_page_url"), F.lit("generic-page"), F.col("license"), F.col("confidence"))
    field = lambda n: F.get_json_object(record, f"$.{n}")
    return c.select("ordinal", field("imageUrl").alias("image"), field("license").alias("license"), field("licenseConfidence").cast("double").alias("sure"))


@query("select count(*) as n from events")
def snk_usage_insert(spark, sf_dir):
    """A batch delivered twice is in the log once."""
    path, u = _folder(spark), usage_of(spark, sf_dir)
    billing.append_usage(u, path)
    return spark.createDataFrame([(billing.append_usage(u, path),)], "n long")


@query("select doc_id, length(substr(text, 1, 1024)) as size from documents where text is not null")
def snk_audit_insert(spark, sf_dir):
    path = _folder(spark)
    audit.append_audit(read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), F.col("text"), path)
    return spark.read.parquet(path).select("doc_id", F.length("meta").cast("long").alias("size"))


_DELIVERIES = "select event_id // 3 as event_id, event_id as id, event_id % 4 <> 0 as ok from events"


@query(f"with d as ({_DELIVERIES}), g as (select event_id, min(id) filter (ok) as good from d group by event_id) select d.event_id, any_value(good) is not null as processed, count(*) filter (not ok and (good is null or id < good)) as failures, count(*) as deliveries from d join g using (event_id) group by d.event_id")
def snk_webhook_ledger(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("event_id"), F.timestamp_seconds("event_id").alias("ts"), (F.col("event_id") % 4 != 0).alias("ok"))
    return billing.ledger(e)


@query(f"with d as ({_DELIVERIES}) select count(distinct event_id) as effects from d where ok")
def st_webhook_idempotent(spark, sf_dir):
    """A replayed stream of deliveries, each event taking effect once."""
    from slatebed.plans.queries import _replayed

    def make(rows: DataFrame) -> DataFrame:
        return streams.first_effects(rows.select(F.floor(F.col("request_id") / 3).alias("event_id"), "ts", (F.col("request_id") % 4 != 0).alias("ok")))

    return _replayed(spark, sf_dir, make, "append").agg(F.count("*").alias("effects"))


@query(f"{U} select count(distinct (endpoint, units)) as n from u")
def st_watch(spark, sf_dir):
    """New addresses of a replayed stream, each shown once to a query."""
    from slatebed.plans.queries import _replayed

    def make(rows: DataFrame) -> DataFrame:
        return streams.new_urls(rows.select("ts", F.col("endpoint").alias("query"), F.col("units").cast("string").alias("url")), late="3650 days")

    return _replayed(spark, sf_dir, make, "append").agg(F.count("*").alias("n"))


@query("select c_custkey, case when c_custkey in (select o_custkey from orders) then 'active' else c_mktsegment end as c_mktsegment from customer")
def snk_update_flags(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    changes = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("c_mktsegment", F.lit("active"))
    return billing.updated(c, changes, "c_custkey", ["c_mktsegment"])


@query("select c_custkey from customer where not coalesce(c_acctbal < 0, false)")
def snk_delete(spark, sf_dir):
    return billing.without(read(spark, sf_dir, "customer"), F.col("c_acctbal") < 0).select("c_custkey")
