"""Named queries of the small functions that other operators are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatebed.dims import PROVIDERS
from slatebed.functions import license as lic
from slatebed.functions import values
from slatebed.operators import candidates as ops
from slatebed.operators import checks, extract, sinks, sites, usage
from slatebed.operators.totals import numbered
from slatebed.plans.inputs import candidates, read
from slatebed.plans.inputs import usage as usage_of
from slatebed.plans.queries import _DAILY, C, U, event_stream, finished, query
from slatebed.plans.search import _ASKED, _HOST, _asked
from slatebed.sources import providers
from slatebed.sources.shared import new_path
from slatebed.streaming import usage as streams

_PRETTY = ", ".join(f"('{row[0]}', '{row[3]}')" for row in PROVIDERS)
_NAMES = "case license when 'CC0' then 'CC0 / Public Domain Dedication' when 'PUBLIC_DOMAIN' then 'Public Domain' when 'CC_BY' then 'CC BY 4.0' when 'CC_BY_SA' then 'CC BY-SA 4.0' when 'EDITORIAL_LICENSED' then 'Editorial Use (platform-licensed)' when 'PRESS_KIT_ALLOWLIST' then 'Official Press Kit' else 'Unknown (rejected)' end"

# -- names and credits


@query(f"with {_ASKED}, n as (select * from (values {_PRETTY}) t(provider, name)) select c_custkey, coalesce(n.name, a.provider) as name from a left join n using (provider)")
def prj_pretty_source(spark, sf_dir):
    """The display name of the source that a customer asks, or its id."""
    return ops.with_source_names(_asked(spark, sf_dir), "provider", "name").select("c_custkey", "name")


@query(f"{C}, e as (select *, case when ordinal % 2 = 0 then 'given ' || ordinal end as given from c) select ordinal, coalesce(given, case when coalesce(title, '') <> '' then '\"' || title || '\"' || coalesce(' by ' || nullif(author, ''), '') when coalesce(author, '') <> '' then 'Photo by ' || author else 'Photo' end || ' (' || source || '), licensed ' || {_NAMES} || ' — ' || source_page_url) as attribution_line from e")
def prj_enrich(spark, sf_dir):
    """A line of credit for candidates that have none."""
    given = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("given "), F.col("ordinal").cast("string")))
    return ops.enrich(candidates(spark, sf_dir).withColumn("attribution_line", given)).select("ordinal", "attribution_line")


@query(f"{C} select ordinal, {_NAMES} as name, license <> 'UNKNOWN' as safe, license in ('CC_BY', 'CC_BY_SA', 'EDITORIAL_LICENSED', 'PRESS_KIT_ALLOWLIST') as credit from c")
def fn_pretty_license(spark, sf_dir):
    tag = F.col("license")
    return candidates(spark, sf_dir).select("ordinal", lic.pretty_license(tag).alias("name"), lic.is_context_safe(tag).alias("safe"), lic.requires_attribution(tag).alias("credit"))


def _tag(name: str, opening: str, value: str, closing: str) -> str:
    return f"coalesce('    {opening}' || nullif(replace(replace(replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&apos;'), '') || '{closing}' || chr(10), '')"


_ALT = "<rdf:Alt><rdf:li xml:lang=\"x-default\">"
_XMP = " || ".join(
    [
        "'<?xpacket begin=\"' || chr(65279) || '\" id=\"W5M0MpCehiHzreSzNTczkc9d\"?>' || chr(10) || '<x:xmpmeta xmlns:x=\"adobe:ns:meta/\" x:xmptk=\"sidecar\">' || chr(10) || '  <rdf:RDF xmlns:rdf=\"http://www.w3.org/1999/02/22-rdf-syntax-ns#\">' || chr(10) || '    <rdf:Description rdf:about=\"\"' || chr(10) || '        xmlns:dc=\"http://purl.org/dc/elements/1.1/\"' || chr(10) || '        xmlns:cc=\"http://creativecommons.org/ns#\"' || chr(10) || '        xmlns:xmpRights=\"http://ns.adobe.com/xap/1.0/rights/\">' || chr(10)",
        _tag("creator", "<dc:creator><rdf:Seq><rdf:li>", "author", "</rdf:li></rdf:Seq></dc:creator>"),
        _tag("rights", f"<dc:rights>{_ALT}", "line", "</rdf:li></rdf:Alt></dc:rights>"),
        _tag("title", f"<dc:title>{_ALT}", "title", "</rdf:li></rdf:Alt></dc:title>"),
        _tag("source", "<dc:source><rdf:Bag><rdf:li>", "page", "</rdf:li></rdf:Bag></dc:source>"),
        _tag("license", "<cc:license>", "coalesce(deed, license)", "</cc:license>"),
        _tag("terms", f"<xmpRights:UsageTerms>{_ALT}", "line", "</rdf:li></rdf:Alt></xmpRights:UsageTerms>"),
        _tag("statement", "<xmpRights:WebStatement>", "coalesce(page, deed)", "</xmpRights:WebStatement>"),
        "'    </rdf:Description>' || chr(10) || '  </rdf:RDF>' || chr(10) || '</x:xmpmeta>' || chr(10) || '<?xpacket end=\"w\"?>' || chr(10)",
    ]
)


@query(f"""{C}, x as (select ordinal, case when ordinal % 5 <> 0 then author end as author, case when ordinal % 7 < 3 and ordinal % 5 <> 0 then 'by "' || source || '" & co' end as line, title, case when ordinal % 5 <> 0 then nullif(license, 'UNKNOWN') end as license, case when license = 'CC0' and ordinal % 5 <> 0 then 'https://cc.example/zero?a=1&b=2' end as deed, case when ordinal % 5 in (1, 2) then source_page_url end as page from c)
select ordinal, case when coalesce(nullif(author, ''), line, license, page, deed) is not null then sha256({_XMP}) end as packet from x""")
def snk_xmp_sidecar(spark, sf_dir):
    """The packet beside each picture, by its digest; pictures without a credit have none."""
    n = F.col("ordinal")
    spoken = n % 5 != 0
    line = F.when((n % 7 < 3) & spoken, F.concat(F.lit('by "'), "source", F.lit('" & co')))
    deed = F.when((F.col("license") == "CC0") & spoken, "https://cc.example/zero?a=1&b=2")
    packet = sinks.xmp_sidecar(F.when(spoken, F.col("author")), line, deed, F.when(spoken, F.nullif("license", F.lit("UNKNOWN"))), F.when((n % 5).isin(1, 2), F.col("source_page_url")), F.col("title"))
    return candidates(spark, sf_dir).select("ordinal", F.sha2(packet, 256).alias("packet"))


# -- addresses

_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query(f"""with p as (select page_id, regexp_extract(url, '^([a-z]+):', 1) as scheme, {_ORIGIN} as origin, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1) as folder, regexp_extract(url, '^([^?#]*)', 1) as bare, substr(md5(html), 1, 6) as w from pages)
select page_id, origin || '/' || w || '.png' as rooted, origin || case when folder = '' then '/' else folder end || w || '/x' as beside, scheme || '://cdn.example/' || w as hosted, 'https://o.example/' || w as whole, case when regexp_matches(bare, '^[a-z]+://[^/]*$') then bare else bare end || '?q=' || w as asked, null::varchar as none from p""")
def fn_resolve_url(spark, sf_dir):
    """Links of all kinds against the pages that they are on."""
    word = F.substring(F.md5(F.col("html").cast("binary")), 1, 6)
    made = lambda before, after="": extract.resolve_url(F.concat(F.lit(before), word, F.lit(after)), F.col("url"))
    none = extract.resolve_url(word, F.lit("nothing"))
    return read(spark, sf_dir, "pages").select("page_id", made("/", ".png").alias("rooted"), made("", "/x").alias("beside"), made("//cdn.example/").alias("hosted"), made("https://o.example/").alias("whole"), made("?q=").alias("asked"), none.alias("none"))


@query("select page_id, substr(md5(url), 1, 11) as id from pages where length(url) % 4 <> 3")
def fn_video_id(spark, sf_dir):
    """Ids bare, in short and in long addresses; the last quarter are no videos."""
    code = F.substring(F.md5(F.col("url").cast("binary")), 1, 11)
    kind = F.length("url") % 4
    asked = F.when(kind == 0, code).when(kind == 1, F.concat(F.lit("https://youtu.be/"), code, F.lit("?t=1"))).when(kind == 2, F.concat(F.lit("https://www.youtube.com/watch?a=b&v="), code, F.lit("&t=1"))).otherwise(F.concat(code, F.lit("x")))
    found = providers.video_thumbnails(read(spark, sf_dir, "pages").select("page_id", asked.alias("query")))
    ids = found.where("ordinal = 0").select("query", F.regexp_extract("url", "/vi/([^/]*)/", 1).alias("id"))
    return read(spark, sf_dir, "pages").select("page_id", asked.alias("query")).join(ids.distinct(), "query").select("page_id", "id")


@query(f"{C} select ordinal, 'https://a.example/' || ordinal || '/1200x1200bb.jpg' as cover, 'https://i.pinimg.com/originals/a/' || ordinal || '.jpg' as pin, 'https://pbs.twimg.com/media/' || ordinal || '?format=png&name=orig' as post from c")
def fn_full_size(spark, sf_dir):
    """Addresses of small pictures on three sites turned into those of the large ones."""
    n, w = F.col("ordinal").cast("string"), F.coalesce("width", F.lit(1)).cast("string")
    cover = F.regexp_replace(F.concat(F.lit("https://a.example/"), n, F.lit("/"), w, F.lit("x"), w, F.lit("bb.jpg")), r"/\d+x\d+bb\.(jpg|png)", "/1200x1200bb.$1")
    pin = sites._original_size(F.concat(F.lit("https://i.pinimg.com/"), w, F.lit("x/a/"), n, F.lit(".jpg")))
    post = sites._original_name(F.concat(F.lit("https://pbs.twimg.com/media/"), n, F.lit("?format=png&name=small")))
    return candidates(spark, sf_dir).select("ordinal", cover.alias("cover"), pin.alias("pin"), post.alias("post"))


@query(f"with h as (select page_id, url, {_HOST} as host from pages) select min(page_id) as page_id, host from h where host is not null group by host")
def set_seen_urls(spark, sf_dir):
    """The first page of each host, as an extractor keeps the first of each address."""
    p = read(spark, sf_dir, "pages").select("page_id", checks.host_of(F.col("url")).alias("host")).where("host is not null")
    return p.groupBy("host").agg(F.min("page_id").alias("page_id"))


@query(f"{C}, h as (select query, arg_max(url, struct_pack(w := coalesce(width, 0), o := -ordinal)) as hero from c group by query) select c.query, ordinal, row_number() over (partition by c.query order by (url <> hero)::int, ordinal) as place from c join h on c.query = h.query")
def hero_float(spark, sf_dir):
    """Each query's widest row goes to the front, the others keep their order."""
    c = candidates(spark, sf_dir).select("query", "ordinal", "url", "width")
    hero = c.groupBy("query").agg(F.max_by("url", F.struct(F.coalesce("width", F.lit(0)).alias("w"), (-F.col("ordinal")).alias("o"))).alias("hero"))
    return numbered(c.join(F.broadcast(hero), "query"), ["query"], [(F.col("url") != F.col("hero")).cast("int"), F.col("ordinal")], "place").select("query", "ordinal", "place")


# -- time and numbers


@query("select event_id, epoch_ms(date_trunc('day', ts)) as day_start, epoch_ms(date_trunc('day', ts) + interval 1 day) as day_end, epoch_ms(date_trunc('month', ts)) as month_start, epoch_ms(date_trunc('month', ts) + interval 1 month) as month_end from events")
def fn_window_bounds(spark, sf_dir):
    """The day and the month of each event, in milliseconds."""
    day, month = usage.plan_window(F.lit("free"), F.col("ts")), usage.plan_window(F.lit("pro"), F.col("ts"))
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_id", ms(day[0]).alias("day_start"), ms(day[1]).alias("day_end"), ms(month[0]).alias("month_start"), ms(month[1]).alias("month_end"))


@query("select strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') as minute, '/v1/' || event_type as endpoint, count(*) as requests from events group by all")
def st_tumbling(spark, sf_dir):
    """Requests by minute of a replayed stream."""
    rows = event_stream(spark, sf_dir).select("ts", F.concat(F.lit("/v1/"), "event_type").alias("endpoint"), F.lit(1).alias("units"))
    done = finished(streams.units_by_window(rows, "1 minute"), "complete")
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "endpoint", "requests")


@query(f"{U}, d as ({_DAILY}) select round(sum(cost_usd), 6) as cost_usd from d")
def agg_total_cost(spark, sf_dir):
    return usage.daily_series(usage_of(spark, sf_dir)).agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query(f"{C} select source, count(*) as n, count(distinct query) as queries from c group by source")
def agg_per_provider(spark, sf_dir):
    return candidates(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("query").alias("queries"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as date, row_number() over (order by strftime(o_orderdate, '%Y-%m-%d') desc, o_orderkey) as place from orders")
def srt_blog(spark, sf_dir):
    """Posts by date as text, the newest first."""
    posts = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return numbered(posts, [], [F.desc("date"), F.col("o_orderkey")], "place")


@query("select c_custkey, case lower(c_mktsegment) when 'building' then 'pro' when 'machinery' then 'team' when 'furniture' then 'enterprise' else 'free' end as plan from customer")
def fn_plan_for(spark, sf_dir):
    """Plans by name; one that isn't known, or none, is the free one."""
    named = F.when(F.col("c_mktsegment") == "BUILDING", "pro").when(F.col("c_mktsegment") == "MACHINERY", "team").when(F.col("c_mktsegment") == "FURNITURE", "enterprise").when(F.col("c_mktsegment") == "HOUSEHOLD", "gold")
    return read(spark, sf_dir, "customer").select("c_custkey", usage.known_plan(named).alias("plan"))


@query("select doc_id, octet_length(encode(coalesce(text, ''))) > 2000 as over, case when n <= 0 then '0 B' when n < 1024 then printf('%.0f B', n) when n < 10240 then printf('%.1f KB', floor(n / 1024 * 10 + 0.5) / 10) when n < 1048576 then printf('%.0f KB', floor(n / 1024 + 0.5)) else printf('%.1f MB', floor(n / 1048576 * 10 + 0.5) / 10) end as shown from (select doc_id, text, octet_length(encode(coalesce(text, '')))::double as n from documents)")
def flt_size_cap(spark, sf_dir):
    """Which texts are over a download's cap, and their sizes for people."""
    n = F.octet_length(F.coalesce("text", F.lit("")))
    error = values.download_error(F.lit("image/png"), n, 2000)
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(error == "too-large", F.lit(False)).alias("over"), values.format_bytes(n.cast("double")).alias("shown"))


@query("select event_id, case when s < 60 then s || 's ago' when s < 3600 then s // 60 || 'm ago' when s < 86400 then s // 3600 || 'h ago' when s < 2592000 then s // 86400 || 'd ago' when s < 31104000 then s // 2592000 || 'mo ago' else s // 31104000 || 'y ago' end as shown from (select event_id, (epoch_ms(timestamp '2024-02-01' + to_days((event_id % 900)::int)) - epoch_ms(ts)) // 1000 as s from events)")
def fn_format_relative(spark, sf_dir):
    now = F.unix_millis(F.lit("2024-02-01").cast("timestamp")) + (F.col("event_id") % 900) * 86_400_000
    return read(spark, sf_dir, "events").select("event_id", values.format_relative(F.unix_millis(F.col("ts").cast("timestamp")), now).alias("shown"))


# -- keys and stores


@query("select c_custkey, substr(sha256('salt.v1:' || c_name), 1, 16) as install, sha256('{\"balance\":' || (c_acctbal * 100)::bigint || ',\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || '}') as cache_key from customer")
def fn_install_hash(spark, sf_dir):
    """What stands for a machine, and the key of a record under any order of its fields."""
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    record = F.to_json(F.struct(cents.alias("balance"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))
    return read(spark, sf_dir, "customer").select("c_custkey", F.substring(F.sha2(F.concat(F.lit("salt.v1:"), "c_name"), 256), 1, 16).alias("install"), F.sha2(record, 256).alias("cache_key"))


@query("with s as (select distinct sha256(coalesce(text, '')) as sha256 from documents) select substr(sha256, 1, 2) as shard, count(*) as blobs from s group by 1")
def snk_cache_put(spark, sf_dir):
    """Texts put by language, then all again: each is in its shard once."""
    store = new_path(spark, "store")
    blobs = read(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    sinks.put_blobs(blobs.where("lang = 'en'").select("content"), store)
    sinks.put_blobs(blobs.select("content"), store)
    return spark.read.schema("content binary, sha256 string, shard string").parquet(store).groupBy("shard").agg(F.count("*").alias("blobs"))


@query("select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(substr(coalesce(text, ''), 1, 50)), '[^A-Za-z0-9_\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') as id from documents")
def fn_slugify_heading(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", checks.heading_id(F.substring(F.coalesce("text", F.lit("")), 1, 50)).alias("id"))
