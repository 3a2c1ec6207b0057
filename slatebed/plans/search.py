"""Named queries of search, health, block lists, exports and small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatebed.dims import PROVIDERS
from slatebed.operators import audit, checks, docsearch, health
from slatebed.plans.inputs import read
from slatebed.plans.inputs import usage as usage_of
from slatebed.plans.queries import U, event_stream, finished, query
from slatebed.sources.shared import written

# -- search

_TITLED = "select doc_id, lower(substr(coalesce(text, ''), 1, 60)) as title, lower(concat_ws(chr(10), substr(coalesce(text, ''), 1, 60), replace(coalesce(text, ''), '. ', '.' || chr(10) || '## '))) as hay from documents"
_HEADS = r"regexp_extract_all(hay, '(?m)^#{2,3}[ \t]+([^\n]+)$', 1)"


@query(f"""with d as ({_TITLED}), h as (select *, array_to_string({_HEADS}, ' ') as heads from d),
q as (select item_id as query_id, unnest(string_split_regex(lower(substr(text, 1, 12)), '\\s+')) as term from benchmark), t as (select query_id, term, count(*) as times from q where term <> '' group by all),
s as (select query_id, doc_id, sum(times * (case when contains(title, term) then 10 else 0 end + case when contains(heads, term) then 5 else 0 end + 1)) as score, count(*) as matched from t join h on contains(hay, term) group by all),
n as (select query_id, count(*) as needed from t group by query_id),
r as (select s.*, row_number() over (partition by query_id order by score desc, doc_id) as place from s join n using (query_id) where matched = needed)
select query_id, doc_id, score::bigint as score, place from r where place <= 12""")
def topk_doc_search(spark, sf_dir):
    """The first words of each benchmark item, asked of all documents at once; each sentence counts as a heading."""
    text = F.coalesce("text", F.lit(""))
    body = F.replace(text, F.lit(". "), F.lit(".\n## "))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.substring(text, 1, 60).alias("title"), body.alias("body"))
    index = written(docsearch.postings(docs), "postings")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 12).alias("text"))
    return docsearch.search(asked, index, docsearch.pieces(index), docsearch.texts(docs))


# -- health


def _requests(events):
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("provider"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration"))


_WINDOWS = "select strftime(time_bucket(interval 5 minutes, ts), '%Y-%m-%d %H:%M') as window_start, user_id::varchar as provider, count(*) as requests, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'error') / count(*) as error_rate, list_sort(list(value))[greatest(1, ceil(0.95 * count(*)))::int] as p95 from events group by all"


@query(_WINDOWS)
def agg_ops_doc(spark, sf_dir):
    """Error rates and the 95th percentile of durations by five minutes and provider."""
    found = health.numbers(health.by_window(_requests(read(spark, sf_dir, "events"))))
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(_WINDOWS)
def st_ops_doc(spark, sf_dir):
    """The same from a stream's finished windows."""
    rows = _requests(event_stream(spark, sf_dir)).withWatermark("ts", "1 hour")
    found = health.numbers(finished(health.by_window(rows), "complete"))
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as requests, count(*) filter (event_type = 'error') as errors, true as near from events group by 1")
def agg_ops_day(spark, sf_dir):
    """Days merged from the sketches of their windows, held against the exact ranks."""
    e = _requests(read(spark, sf_dir, "events"))
    day = F.date_format("window_start", "yyyy-MM-dd").alias("day")
    merged = health.numbers(health.merged(health.by_window(e), day)).select("day", "requests", "errors", "p95")
    ranks = e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "duration").join(F.broadcast(merged.select("day", "p95")), "day")
    exact = ranks.groupBy("day").agg((F.count_if(F.col("duration") <= F.col("p95")) / F.count("*")).alias("at_most"), (F.count_if(F.col("duration") < F.col("p95")) / F.count("*")).alias("below"))
    near = (F.col("at_most") >= 0.95 - 2 / health.K) & (F.col("below") <= 0.95 + 2 / health.K)
    return merged.join(exact, "day").select("day", "requests", "errors", near.alias("near"))


# -- block lists and small rules

_HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)), '')"


@query(f"""with h as (select page_id, url, {_HOST} as host from pages), b as (select distinct regexp_replace(host, '^(www|m|blog)[.]', '') as host from h where contains(url, '/es/')),
x as (select distinct host from h where contains(url, '.html')) select page_id from h where host is not null and not exists (select 1 from b where h.host = b.host or h.host like '%.' || b.host) and not exists (select 1 from x where x.host = h.host) or host is null""")
def flt_host_blocklist(spark, sf_dir):
    """Pages but for sites with Spanish pages, all hosts below them too, and for hosts that serve .html themselves."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    host = checks.host_of(F.col("url"))
    domains = p.where(F.col("url").contains("/es/")).select(F.regexp_replace(host, r"^(www|m|blog)\.", "").alias("host"), F.lit(True).alias("below"))
    exact = p.where(F.col("url").contains(".html")).select(host.alias("host"), F.lit(False).alias("below"))
    return checks.not_blocked(p, "url", domains.union(exact)).select("page_id")


@query("select c_custkey, case when md5(c_name) < '8' then 'sk_test_' || md5(c_name) end as token from customer where c_mktsegment <> 'MACHINERY' union all select c_custkey, null from customer where c_mktsegment = 'MACHINERY'")
def flt_bearer(spark, sf_dir):
    """Headers of good, short and otherwise wrong keys."""
    digits = F.md5(F.col("c_name").cast("binary"))
    scheme = F.when(F.col("c_mktsegment") == "MACHINERY", "Basic").when(F.col("c_mktsegment") == "BUILDING", " bearer ").otherwise("Bearer")
    key = F.concat(F.lit("sk_test_"), F.when(digits < "8", digits).otherwise(F.substring(digits, 1, 31)))
    return read(spark, sf_dir, "customer").select("c_custkey", checks.bearer_token(F.concat(scheme, F.lit(" "), key, F.lit(" ")), "sk_test_").alias("token"))


_IDS = [row[0] for row in PROVIDERS]
_ID_LIST = ", ".join(f"'{x}'" for x in [*_IDS, "nowhere"])
_NEED_ROWS = ", ".join(f"('{p}', '{s}', {i})" for p, ss in checks.NEEDS.items() for i, s in enumerate(ss))
#: Providers that customers ask, by the letters of their names' hash; settings they have, by those of their segments.
_ASKED = f"a as (select c_custkey, ([{_ID_LIST}])[('0x' || substr(md5(c_name), 1, 6))::bigint % {len(_IDS) + 1} + 1] as provider, c_mktsegment as segment, c_acctbal > 0 as named from customer)"


def _asked(spark, sf_dir):
    number = F.conv(F.substring(F.md5(F.col("c_name").cast("binary")), 1, 6), 16, 10).cast("long")
    ids = F.array(*map(F.lit, [*_IDS, "nowhere"]))
    return read(spark, sf_dir, "customer").select("c_custkey", F.element_at(ids, (number % (len(_IDS) + 1) + 1).cast("int")).alias("provider"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") > 0).alias("named"))


@query(f"with {_ASKED}, n as (select * from (values {_NEED_ROWS}) t(provider, setting, i)) select c_custkey, 'provider ' || a.provider || ': missing env ' || string_agg(setting, ', ' order by i) || ' — will be skipped' as warning from a join n on a.provider = n.provider where setting[1:1] <> segment[1:1] group by c_custkey, a.provider")
def flt_missing_auth(spark, sf_dir):
    """Customers have the settings that begin with their segment's letter."""
    every = F.array(*(F.lit(s) for s in sorted({s for ss in checks.NEEDS.values() for s in ss})))
    own = F.filter(every, lambda s: F.substring(s, 1, 1) == F.substring("segment", 1, 1))
    told = _asked(spark, sf_dir).select("c_custkey", checks.missing_auth_warning(F.col("provider"), own).alias("warning"))
    return told.where("warning is not null")


@query(f"with {_ASKED} select c_custkey, provider, case when provider = 'nowhere' then 'unknown provider' when provider in ('bing', 'serpapi', 'browser', 'europeana-archival', 'managed-browser') and not named then 'not-enabled' else 'run' end as state from a")
def flt_provider_optin(spark, sf_dir):
    return checks.provider_report(_asked(spark, sf_dir)).select("c_custkey", "provider", "state")


@query(rf"""with p as (select page_id, {_HOST} as host, url, '/' || (['search', 'usage', 'v1/probe', 'download'])[length(url) % 4 + 1] as path from pages)
select page_id, case when path in ('/search', '/download') and host like '%.example.org' and not regexp_matches(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/v1/*$') then '/v1' || path else path end as path from p where host like '%.example.org' and host = (select min(host) from p where host like '%.example.org')
union all select page_id, path from p where host is null or host <> (select min(host) from p where host like '%.example.org')""")
def fn_api_path(spark, sf_dir):
    """The pages' addresses as bases, the first host under example.org being the hosted service."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    hosted = p.select(checks.host_of(F.col("url")).alias("host")).where("host like '%.example.org'").agg(F.min("host")).first()[0] or ""
    path = F.element_at(F.array(*map(F.lit, ("search", "/usage", "v1/probe", "/download"))), (F.length("url") % 4 + 1).cast("int"))
    return p.select("page_id", checks.api_path(F.col("url"), path, hosted).alias("path"))


@query(f"{U}, n as (select endpoint, count(*) as n from u group by endpoint) select endpoint, n / greatest(1, max(n) over ()) * 100 as pct, case when max(n) over () = min(n) over () then 0.5 else (n - min(n) over ()) / (max(n) over () - min(n) over ()) end as level from n")
def agg_max_scale(spark, sf_dir):
    n = usage_of(spark, sf_dir).groupBy("endpoint").agg(F.count("*").alias("n"))
    return checks.share_of_most(n, "n").select("endpoint", "pct", "level")


@query("select p_name as name, p_partkey as id from part where not starts_with(p_name, 'red ') union all select 'red ' || s_name, s_suppkey from supplier")
def set_replace_merge(spark, sf_dir):
    old = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    new = read(spark, sf_dir, "supplier").select(F.concat(F.lit("red "), "s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return checks.replaced(old, new, "name", "red ")


_MD = "replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || '## '), ', ', ',' || chr(10) || '###' || chr(9))"


@query(rf"""with d as (select doc_id, {_MD} as body from documents), m as (select doc_id, regexp_extract_all(body, '(?m)^(#{{2,3}})[ \t]+([^\n]+)$', 1) as marks, regexp_extract_all(body, '(?m)^(#{{2,3}})[ \t]+([^\n]+)$', 2) as texts from d),
x as (select doc_id, unnest(range(0, len(texts)))::int as place, unnest(marks) as mark, trim(unnest(texts), ' ') as text from m)
select doc_id, place, length(mark)::int as level, md5(text) as text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^A-Za-z0-9_\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') as id from x""")
def ext_markdown_headings(spark, sf_dir):
    """Sentences as second and parts of them as third level headings."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr(_MD.replace("chr(", "char(")).alias("body"))
    return checks.markdown_headings(docs).withColumn("text", F.md5(F.col("text").cast("binary")))


# -- exports

_AT = "timestamp '2024-01-05' and timestamp '2024-01-25'"


@query(f"""{U}, r as (select *, row_number() over (order by ts, request_id) as n from u where ts between {_AT})
select n, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ',' || api_key || ',' || case when units > 1 then endpoint else 'none' end || ',' || case when units = 2 then 'POST' else '' end || ',' || units || ',' || case when value = floor(value) then value::bigint::varchar else value::varchar end || ',' || 'the "p", ' || '' || ',,' || endpoint as line from r where false
union all select n, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ',' || api_key || ',' || case when units > 1 then endpoint else 'none' end || ',' || case when units = 2 then 'POST' else '' end || ',' || units || ',' || case when value = floor(value) then value::bigint::varchar else value::varchar end || ',"a ""p"", ' || workspace_id || '",,' || endpoint from r
union all select 0, 'ts,user_id,endpoint,method,status,duration_ms,provider,ip,action'""")
def snk_csv_audit(spark, sf_dir):
    """The log as audit rows, what the requests were being in their meta."""
    u = usage_of(spark, sf_dir)
    heavy = F.struct(
        F.when(F.col("units") > 1, F.col("endpoint")).alias("endpoint"), F.when(F.col("units") == 2, "POST").alias("method"), F.col("units").alias("status"), F.col("value").alias("durationMs"),
        F.concat(F.lit('a "p", '), "workspace_id").alias("provider"), F.lit(None).cast("string").alias("ip"), F.col("props").alias("other"),
    )
    rows = u.select(F.col("request_id").alias("id"), "ts", F.col("api_key").alias("user_id"), F.lit("none").alias("target_id"), F.col("endpoint").alias("action"), F.to_json(heavy).alias("meta"))
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return checks.audit_csv(rows, at("2024-01-05"), at("2024-01-25"))


@query(f"""{U}, f as (select min(request_id) filter (units > 1) as heavy, min(request_id) filter (units = 1) as light from u)
select request_id + 1 as n, endpoint || case when heavy < light then ',' || case when units > 1 then units::varchar else '' end || ',' || case when units = 1 then '"' || replace(props, '"', '""') || '"' else '' end
  else ',' || case when units = 1 then '"' || replace(props, '"', '""') || '"' else '' end || ',' || case when units > 1 then units::varchar else '' end end as line from u, f
union all select 0, 'endpoint' || case when heavy < light then ',units,props' else ',props,units' end from f""")
def snk_csv_usage(spark, sf_dir):
    """Records of two kinds: the header has the keys of both as they are first seen."""
    heavy = F.col("units") > 1
    record = F.when(heavy, F.create_map(F.lit("endpoint"), F.col("endpoint"), F.lit("units"), F.col("units").cast("string"))).otherwise(F.create_map(F.lit("endpoint"), F.col("endpoint"), F.lit("props"), F.col("props")))
    return checks.csv_table(usage_of(spark, sf_dir).select("request_id", record.alias("record")), "record", "request_id")


# -- scrubbing

_STRING = "substr(coalesce(text, ''), 1, 40)"


@query(f"select doc_id, {_STRING} as text, '[REDACTED]' as api_key, 'Bearer [REDACTED] ' || lang as note, '[REDACTED]' as session, n_chars, '[TRUNCATED]' as deep from documents")
def fn_scrub_value(spark, sf_dir):
    """Nested records of documents with keys and tokens in them."""
    deep = F.col("source")
    for _ in range(6):
        deep = F.struct(deep.alias("in"))
    note = F.concat(F.lit("bearer a."), F.col("doc_id").cast("string"), F.lit(" "), "lang")
    doc = F.struct(F.expr(_STRING).alias("text"), F.col("source").alias("Api-Key"), F.array(F.lit(None).cast("string"), note).alias("notes"))
    raw = F.to_json(F.struct(doc.alias("doc"), F.struct("lang").alias("session"), "n_chars", deep.alias("deep")), {"ignoreNullFields": "false"})
    clean = read(spark, sf_dir, "documents").select("doc_id", "lang", audit.scrub_json(raw).alias("clean"))
    field = lambda path: F.get_json_object("clean", path)
    return clean.select(
        "doc_id", field("$.doc.text").alias("text"), field("$.doc.Api-Key").alias("api_key"), field("$.doc.notes[1]").alias("note"), field("$.session").alias("session"), field("$.n_chars").cast("long").alias("n_chars"),
        field("$.deep.in.in.in.in.in.in").alias("deep"),
    )


@query(r"""select doc_id, array_to_string(list_filter([case when lang <> '' and not regexp_matches(lang, '@|[/\\]') then 'lang' end, 'n_chars', case when text is not null and length(text) <= 128 and not regexp_matches(text, '@|[/\\]') then 'text' end, 'wide'], lambda x: x is not null), ',') as kept, n_chars, n_chars > 1000 as wide from documents""")
def flt_telemetry_scrub(spark, sf_dir):
    """Properties of all kinds: texts are looked at, numbers and booleans stay, the rest goes."""
    raw = F.to_json(F.struct("text", "lang", "n_chars", (F.col("n_chars") > 1000).alias("wide"), F.array("doc_id").alias("list"), F.struct("doc_id").alias("inner")))
    kept = read(spark, sf_dir, "documents").select("doc_id", audit.telemetry_props(raw).alias("props"))
    field = lambda n: F.get_json_object("props", f"$.{n}")
    return kept.select("doc_id", F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("kept"), field("n_chars").cast("long").alias("n_chars"), field("wide").cast("boolean").alias("wide"))
