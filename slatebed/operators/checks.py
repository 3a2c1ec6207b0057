"""Small rules about keys, providers, paths, hosts and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatebed.dims import PROVIDERS
from slatebed.functions.urls import host_of

# The settings that a provider needs to be asked.
NEEDS = {
    "unsplash": ("UNSPLASH_ACCESS_KEY",), "pexels": ("PEXELS_API_KEY",), "pixabay": ("PIXABAY_API_KEY",), "spotify": ("SPOTIFY_CLIENT_ID", "SPOTIFY_CLIENT_SECRET"),
    "brave": ("BRAVE_API_KEY",), "bing": ("BING_API_KEY",), "serpapi": ("SERPAPI_KEY",), "flickr": ("FLICKR_API_KEY",), "smithsonian": ("SMITHSONIAN_API_KEY",),
    "europeana": ("EUROPEANA_API_KEY",), "europeana-archival": ("EUROPEANA_API_KEY",), "managed-browser": ("BRIGHTDATA_API_TOKEN",),
}
# Paths that are metered, and so have a version in front on the hosted service.
VERSIONED = ("/search", "/artist", "/album", "/download", "/probe", "/license", "/similar")


def bearer_token(header: Column, prefix: str, digits: int = 32) -> Column:
    """The key of an authorization header, null if the scheme, the key's prefix or its length is wrong."""
    token = F.trim(F.regexp_extract(F.trim(header), r"(?i)^Bearer\s+(.+)$", 1))
    return F.when(token.startswith(prefix) & (F.length(token) == len(prefix) + digits), token)


def missing_settings(provider: Column, known: Column) -> Column:
    """The settings that a provider needs and ``known`` (an array of names) doesn't have; empty if it can be asked."""
    needed = F.array().cast("array<string>")
    for name, settings in NEEDS.items():
        needed = F.when(provider == name, F.array(*map(F.lit, settings))).otherwise(needed)
    return F.filter(needed, lambda s: ~F.array_contains(F.coalesce(known, F.array().cast("array<string>")), s))


def missing_auth_warning(provider: Column, known: Column) -> Column:
    """What is said of a provider that will be passed over for want of settings; null for others."""
    missing = missing_settings(provider, known)
    return F.when(F.size(missing) > 0, F.concat(F.lit("provider "), provider, F.lit(": missing env "), F.array_join(missing, ", "), F.lit(" — will be skipped")))


def provider_report(asked: DataFrame) -> DataFrame:
    """``asked(request, provider, named)`` with what becomes of each: run, not-enabled or unknown provider.

    Providers to opt into run only where a request names them.
    """
    opt_in = [row[0] for row in PROVIDERS if row[1]]
    known = F.col("provider").isin(*[row[0] for row in PROVIDERS])
    state = F.when(~F.coalesce(known, F.lit(False)), "unknown provider").when(F.col("provider").isin(*opt_in) & ~F.coalesce(F.col("named"), F.lit(False)), "not-enabled").otherwise("run")
    return asked.withColumn("state", state)


def api_path(base: Column, path: Column, hosted: str, version: str = "/v1") -> Column:
    """A path as the service at a base address has it: metered ones get the version in front, on the hosted one only."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    has_version = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "").endswith(version)
    add = full.isin(*VERSIONED) & ~has_version & (host_of(base) == hosted)
    return F.when(full.startswith(f"{version}/"), full).when(F.coalesce(add, F.lit(False)), F.concat(F.lit(version), full)).otherwise(full)


def not_blocked(rows: DataFrame, url: str, blocked: DataFrame) -> DataFrame:
    """Rows whose host is on no block list.

    ``blocked(host, below)`` is of any size: with ``below`` a host stands for
    all hosts under it too. Each different host is looked up by itself and its
    endings, with an equi-join; what it finds is then taken out of the rows.
    """
    hosts = rows.select(host_of(F.col(url)).alias("_host")).where("_host is not null").distinct()
    parts = F.split("_host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("host"), (i > 1).alias("under")))
    listed = blocked.select(F.lower("host").alias("host"), F.coalesce("below", F.lit(False)).alias("below")).groupBy("host").agg(F.bool_or("below").alias("below"))
    gone = hosts.select("_host", F.inline(endings)).join(listed, "host").where("below or not under").select("_host").distinct()
    return rows.withColumn("_host", host_of(F.col(url))).join(gone, "_host", "left_anti").select(rows.columns)


def share_of_most(values: DataFrame, value: str) -> DataFrame:
    """Rows with their share of the largest value in percent, the largest being 1 at least, and their place between least and largest."""
    ends = values.agg(F.max(value).alias("_high"), F.min(value).alias("_low"))
    width = F.col("_high") - F.col("_low")
    scaled = values.crossJoin(F.broadcast(ends))  # one row
    return scaled.select(
        *values.columns, (F.col(value) / F.greatest(F.lit(1), F.col("_high")) * 100).alias("pct"), F.when(width == 0, 0.5).otherwise((F.col(value) - F.col("_low")) / width).alias("level")
    )


def replaced(old: DataFrame, new: DataFrame, name: str, prefix: str) -> DataFrame:
    """A listing whose entries under a prefix are those of ``new``."""
    return old.where(~F.coalesce(F.col(name).startswith(prefix), F.lit(False))).unionByName(new)


def csv_table(rows: DataFrame, record: str, order: str) -> DataFrame:
    """``n, line`` of a table of records (maps of strings): a header of all keys in order of first sight, then the rows.

    The header is as long as there are different keys. No rows, no lines.
    """
    from slatebed.functions.values import csv_cell
    from slatebed.operators.totals import numbered

    seen = rows.select(order, F.posexplode(F.map_keys(record)).alias("i", "key")).groupBy("key").agg(F.min(F.struct(order, "i")).alias("at"))
    keys = [r["key"] for r in seen.orderBy("at", "key").collect()]
    if not keys:
        return rows.select(F.lit(0).cast("long").alias("n"), F.lit("").alias("line")).limit(0)
    line = F.array_join(F.array(*(csv_cell(F.col(record)[k]) for k in keys)), ",")
    body = numbered(rows.select(order, line.alias("line")), [], [F.col(order)], "n").select("n", "line")
    head = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(",".join(keys)).alias("line"))
    return head.union(body)


def audit_csv(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """``n, line`` of the nine-column audit export, oldest first, with its header.

    ``rows(id, ts, user_id, target_id, action, meta)``; what middleware has put
    into the JSON of ``meta`` is lifted out, anything else there is left alone.
    """
    from slatebed.functions.values import csv_cell
    from slatebed.operators.totals import numbered

    header = ["ts", "user_id", "endpoint", "method", "status", "duration_ms", "provider", "ip", "action"]
    meta = F.try_parse_json(F.col("meta"))
    text = lambda name: F.coalesce(F.try_variant_get(meta, f"$.{name}", "string"), F.lit(""))

    def number(*names: str) -> Column:
        value = F.coalesce(*(F.try_variant_get(meta, f"$.{n}", "double") for n in names))
        return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))

    cells = [
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.col("user_id"), F.coalesce(F.nullif(text("endpoint"), F.lit("")), F.col("target_id")), text("method"), number("status"),
        number("duration_ms", "durationMs"), text("provider"), text("ip"), F.col("action"),
    ]
    lines = rows.where(F.col("ts").between(low, high)).select("ts", "id", F.concat_ws(",", *(csv_cell(c, also_cr=True) for c in cells)).alias("line"))
    body = numbered(lines, [], [F.col("ts"), F.col("id")], "n").select("n", "line")
    return rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(",".join(header)).alias("line")).union(body)


def heading_id(text: Column) -> Column:
    """The anchor of a heading: small letters, digits, underscores and single hyphens."""
    bare = F.regexp_replace(F.lower(text), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\s+", "-"), "-+", "-"), "^-|-$", "")


def markdown_headings(docs: DataFrame) -> DataFrame:
    """``doc_id, place, level, text, id`` of the second and third level headings of ``docs(doc_id, body)``."""
    pattern = r"(?m)^(#{2,3})[ \t]+([^\n]+)$"
    found = F.arrays_zip(F.regexp_extract_all("body", F.lit(pattern), 1).alias("mark"), F.regexp_extract_all("body", F.lit(pattern), 2).alias("text"))
    each = docs.select("doc_id", F.posexplode(found).alias("place", "h"))
    return each.select("doc_id", "place", F.length("h.mark").alias("level"), F.trim("h.text").alias("text"), heading_id(F.trim("h.text")).alias("id"))
