"""Reading and writing of audit rows and usage logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatebed.functions.values import csv_cell

# Events that may be sent, roles by what they may do, keys and tokens that are hidden.
EVENTS = ("cli_invoked", "search_completed", "fetch_completed", "provider_error", "telemetry_enabled", "telemetry_disabled")
MANAGERS, PAYERS, MAKERS = ("owner", "admin"), ("owner", "admin", "billing"), ("owner", "admin", "member")
HIDDEN_KEY = "api[_-]?key|secret|token|password|passwd|pwd|bearer|authorization|session|cookie|ssn"
BEARER = r"Bearer\s+[A-Za-z0-9._~+/=-]+"
DEEPEST, LONGEST_META, LONGEST_TEXT = 6, 1024, 128


def between(rows: DataFrame, workspace: Column, low: Column, high: Column) -> DataFrame:
    """Rows of a workspace from one time to another, both included."""
    return rows.where(workspace & F.col("ts").between(low, high))


def contains_any(needle: str, *columns: str) -> Column:
    return F.greatest(*(F.coalesce(F.col(c), F.lit("")).contains(needle).cast("int") for c in columns)) == 1 if len(columns) > 1 else F.coalesce(F.col(columns[0]), F.lit("")).contains(needle)


def latest_points(daily: DataFrame, n: int) -> DataFrame:
    """The last n points of a series of days, by place and not by date; it has a row a day."""
    return daily.withColumn("_back", F.row_number().over(Window.orderBy(F.desc("day")))).where(F.col("_back") <= n).drop("_back")


def meta_field(meta: Column, name: str) -> Column:
    """A field of a JSON object, null for anything else."""
    return F.get_json_object(meta, f"$.{name}")


def audit_line(*cells: Column) -> Column:
    return F.concat_ws(",", *(csv_cell(c) for c in cells))


def append_audit(rows: DataFrame, meta: Column, path: str) -> None:
    """Appends rows, their meta as JSON of at most 1024 characters."""
    rows.withColumn("meta", F.substring(meta, 1, LONGEST_META)).write.mode("append").parquet(path)


def _members(value: Column) -> Column:
    """``array<struct<key, value>>`` of a VARIANT: an object's members, an array's with null keys, null for a scalar."""
    members = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(members, items)


def _kind(value: Column) -> Column:
    """The name of a VARIANT's type, without what is inside."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def _text_json(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def telemetry_props(props: Column) -> Column:
    """The JSON of an object's numbers, booleans and strings, without long strings and those that hold an address or a path."""
    entries = F.map_entries(F.try_variant_get(F.try_parse_json(props), "$", "map<string,variant>"))

    def kept(e: Column) -> Column:
        text = F.try_variant_get(e["value"], "$", "string")
        fine = (F.length(text) <= LONGEST_TEXT) & ~text.rlike(r"@|[/\\]")
        return F.when(_kind(e["value"]) == "STRING", fine).otherwise(_kind(e["value"]).isin("BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN"))

    shown = F.transform(F.filter(entries, kept), lambda e: F.concat(_text_json(e["key"]), F.lit(":"), F.to_json(e["value"])))
    return F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}"))


def _scrubbed(value: Column, depth: int) -> Column:
    """JSON of a VARIANT and, one expression inside the other, of what is in it down to DEEPEST."""
    if depth > DEEPEST:
        return F.lit('"[TRUNCATED]"')
    text = F.regexp_replace(F.try_variant_get(value, "$", "string"), f"(?i){BEARER}", "Bearer [REDACTED]")
    scalar = F.when(_kind(value) == "STRING", _text_json(text)).otherwise(F.coalesce(F.to_json(value), F.lit("null")))

    def member(m: Column) -> Column:
        inner = F.when(m["key"].rlike(f"(?i){HIDDEN_KEY}"), '"[REDACTED]"').otherwise(_scrubbed(m["value"], depth + 1))
        return F.concat(F.coalesce(F.concat(_text_json(m["key"]), F.lit(":")), F.lit("")), inner)

    inside = F.array_join(F.transform(_members(value), member), ",")
    return F.when(_kind(value) == "OBJECT", F.concat(F.lit("{"), inside, F.lit("}"))).when(_kind(value) == "ARRAY", F.concat(F.lit("["), inside, F.lit("]"))).otherwise(scalar)


def scrub_json(text: Column) -> Column:
    """JSON with values of sensitive keys and bearer tokens hidden, cut below the sixth level; null if it is none.

    Keys come back in alphabetical order.
    """
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNotNull(), _scrubbed(parsed, 0))


def captcha_kind(html: Column) -> Column:
    """turnstile, recaptcha-v2, recaptcha-v3 or hcaptcha, the first that a page shows; null for none."""
    tags = F.regexp_extract_all(html, F.lit("<[^>]+>"), 0)
    shown = lambda name: F.exists(tags, lambda t: t.rlike(rf"""(?i)class=["'][^"']*{name}""") & t.rlike(r"(?i)data-sitekey=[\"'][^\"']"))
    return (
        F.when(shown("cf-turnstile"), "turnstile").when(shown("g-recaptcha"), "recaptcha-v2").when(html.rlike(r"recaptcha/api\.js\?render=[A-Za-z0-9_-]"), "recaptcha-v3").when(shown("h-captcha"), "hcaptcha")
    )


def newest(rows: DataFrame, limit: int) -> DataFrame:
    """The newest rows of a log, a limit being held between 1 and 1000."""
    return rows.orderBy(F.desc("ts"), F.desc("request_id")).limit(max(1, min(1000, limit)))
