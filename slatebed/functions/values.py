"""Money, time, text and hash expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# -- money and usage


def units_for(endpoint: Column) -> Column:
    return F.when(endpoint == "/v1/download", 2).when(endpoint == "/v1/similar", 3).otherwise(1)


def project_cost(plan: Column, units: Column, base_cents: Column, included: Column, overage_millicents: Column) -> Column:
    """``struct(base_cents, overage_units, overage_cents, total_cents)``, cents rounded half up."""
    metered = plan.isin("pro", "team")
    over = F.when(metered, F.greatest(units - included, F.lit(0))).otherwise(F.lit(0)).cast("long")
    cents = F.floor((over * overage_millicents + 500) / 1000).cast("long")
    return F.struct(
        base_cents.cast("long").alias("base_cents"),
        over.alias("overage_units"),
        cents.alias("overage_cents"),
        (base_cents + cents).cast("long").alias("total_cents"),
    )


def retention_days(plan: Column, override: Column) -> Column:
    """Days by plan, 365 for one that isn't known; only enterprise may override, with more than 0."""
    usual = F.when(plan == "free", 90).when(plan == "pro", 180).otherwise(365)
    return F.when((plan == "enterprise") & (override > 0), override).otherwise(usual).cast("int")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


# -- time


def parse_interval(text: Column) -> Column:
    """Milliseconds of 30s, 15m, 2h, 1d; null for anything else."""
    number = F.regexp_extract(text, r"^(\d+)([smhd])$", 1).try_cast("long")
    unit = F.regexp_extract(text, r"^(\d+)([smhd])$", 2)
    return number * F.when(unit == "s", 1000).when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000)


def ulid_time(ms: Column) -> Column:
    """The ten base-32 digits of a time-sortable id."""
    digits = F.lit("0123456789ABCDEFGHJKMNPQRSTVWXYZ")
    places = F.transform(
        F.sequence(F.lit(9), F.lit(0), F.lit(-1)),
        lambda i: F.substr(digits, (F.floor(ms / F.pow(F.lit(32.0), i)).cast("long") % 32 + 1).cast("int"), F.lit(1)),
    )
    return F.array_join(places, "")


# -- text


def strip_html(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, "<[^>]+>", "")), F.lit(""))


def truncate(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def looks_personal(query: Column) -> Column:
    return query.rlike(r"\b\d{3}-\d{2}-\d{4}\b|\b\d{16}\b|@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}")


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def csv_cell(text: Column, also_cr: bool = False) -> Column:
    """Quoted if it holds a quote, comma or line end; null is empty."""
    value = F.coalesce(text.cast("string"), F.lit(""))
    marks = '[",\n\r]' if also_cr else '[",\n]'
    return F.when(value.rlike(marks), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def mask_key(prefix: Column) -> Column:
    return F.concat(prefix, F.repeat(F.lit("•"), 24))


def _decomposed(text: Column) -> Column:
    """Text with its letters and marks apart and the marks U+0300 to U+036F gone."""

    @F.pandas_udf("string")
    def apart(column: pd.Series) -> pd.Series:
        return column.str.normalize("NFKD").str.replace("[\u0300-\u036f]", "", regex=True)

    return apart(text)


def slug(text: Column) -> Column:
    """Up to 48 letters and digits with hyphens between, accents gone, of a title; image if nothing is left."""
    low = F.lower(_decomposed(text))
    cut = F.substring(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 48)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("image"))


def format_bytes(n: Column) -> Column:
    """A size for people: one digit after the point below ten of a unit, none for bytes."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.lit("0 B")
    for i, unit in enumerate(units):
        v = n / float(1024**i)
        shown = F.when((v < 10) & F.lit(i > 0), F.format_string("%.1f", v)).otherwise(F.format_string("%.0f", v))
        out = F.when(n >= 1024**i, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return F.when(n > 0, out).otherwise("0 B")


def format_relative(ms: Column, now: Column) -> Column:
    """How long ago a time is, in its largest whole unit."""
    s = F.floor((now - ms) / 1000)
    m, h = F.floor(s / 60), F.floor(s / 3600)
    d = F.floor(h / 24)
    mo = F.floor(d / 30)
    shown = lambda x, unit: F.concat(x.cast("string"), F.lit(f"{unit} ago"))
    ladder = F.when(s < 60, shown(s, "s")).when(m < 60, shown(m, "m")).when(h < 24, shown(h, "h")).when(d < 30, shown(d, "d")).when(mo < 12, shown(mo, "mo")).otherwise(shown(F.floor(mo / 12), "y"))
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "never").when(now < ms, "in the future").otherwise(ladder)


# -- hashes


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside of array functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ in two hexadecimal hashes; four for each digit only one has."""
    both = F.least(F.length(a), F.length(b))
    number = lambda h, i: F.conv(F.substr(h, i, F.least(F.lit(8), both - i + 1)), 16, 10).cast("long")
    parts = F.transform(F.sequence(F.lit(1), both, F.lit(8)), lambda i: F.bit_count(number(a, i).bitwiseXOR(number(b, i))))
    inner = F.when(both > 0, F.aggregate(parts, F.lit(0), lambda s, x: s + x)).otherwise(0)
    return (inner + 4 * F.abs(F.length(a) - F.length(b))).cast("int")


def median_bits(values: Column) -> Column:
    """64 numbers to 16 hexadecimal digits: a bit says that a number is above the upper median."""
    middle = F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
    bits = let(middle, lambda m: F.array_join(F.transform(values, lambda x: F.when(x > m, "1").otherwise("0")), ""))
    hexadecimal = lambda text: F.lower(F.lpad(F.conv(text, 2, 16), 8, "0"))
    return let(bits, lambda b: F.concat(hexadecimal(F.substring(b, 1, 32)), hexadecimal(F.substring(b, 33, 32))))


def _average_hash(data: bytes) -> str:
    if not data:
        return "0" * 16
    values = np.frombuffer(data, np.uint8).astype(np.float64)
    window = np.arange(len(values)) * 64 // len(values)
    counts = np.bincount(window, minlength=64)
    means = np.bincount(window, values, 64) / np.maximum(counts, 1)
    return np.packbits(means > values.sum() / len(values)).tobytes().hex()


def average_hash(data: Column) -> Column:
    """64 windows of bytes against the mean of all; for undecoded images."""

    @F.pandas_udf("string")
    def hashed(column: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else _average_hash(bytes(b)) for b in column], dtype=object)

    return hashed(data)


def _dct_matrix(n: int = 32) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    scale = np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))
    return scale * np.cos(np.pi * (2 * x + 1) * k / (2 * n))


def _dct_hashes(images: np.ndarray) -> list[str]:
    basis = _dct_matrix()
    low = (basis @ images @ basis.T)[:, :8, :8].reshape(len(images), 64)
    low = np.concatenate((low[:, 1:], low[:, :1]), axis=1)  # the constant term goes last
    middle = np.sort(low, axis=1)[:, 32:33]
    return [h.tobytes().hex() for h in np.packbits(low > middle, axis=1)]


def dct_hash(pixels: Column) -> Column:
    """32 x 32 grey pixels to a hash of the 64 lowest frequencies; null for other lengths."""

    @F.pandas_udf("string")
    def hashed(column: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(column), dtype=object)
        fits = [i for i, p in enumerate(column) if p is not None and len(p) == 1024]
        if fits:
            images = np.stack([np.asarray(column.iloc[i], np.float64).reshape(32, 32) for i in fits])
            for i, h in zip(fits, _dct_hashes(images)):
                out.iloc[i] = h
        return out

    return hashed(pixels)


def download_error(mime: Column, size: Column, most: int) -> Column:
    """What is wrong with a download: bad-type, too-large or null."""
    kind = F.trim(F.substring_index(F.coalesce(mime, F.lit("application/octet-stream")), ";", 1))
    return F.when(~kind.startswith("image/"), "bad-type").when(size > most, "too-large")


# Endings by a part of the type, in order.
ENDINGS = [("jpeg", ".jpg"), ("jpg", ".jpg"), ("png", ".png"), ("webp", ".webp"), ("gif", ".gif"), ("avif", ".avif"), ("svg", ".svg")]


def file_ending(mime: Column, url: Column) -> Column:
    """By the type, else by the address's path, else .img."""
    path = F.lower(F.regexp_extract(url, "^[^?#]*", 0))
    out = F.lit(".img")
    for part, ending in reversed(ENDINGS):
        out = F.when(path.endswith("." + part), ending).otherwise(out)
    for part, ending in reversed(ENDINGS):
        out = F.when(F.lower(mime).contains(part), ending).otherwise(out)
    return out
