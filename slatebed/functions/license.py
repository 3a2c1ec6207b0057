"""License expressions: coercion of free text, hosts, ranks, attribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatebed.dims import CONTEXT_SAFE, LICENSES, OPEN
from slatebed.functions.urls import host_of

# Host ending, license, confidence; the first that fits counts.
HOST_LICENSES = [
    (("commons.wikimedia.org", "upload.wikimedia.org"), "CC_BY_SA", 0.4),
    (("flickr.com", "staticflickr.com"), "UNKNOWN", 0.1),
    (("unsplash.com",), "CC0", 0.8),
    (("pexels.com",), "CC0", 0.8),
    (("pixabay.com",), "CC0", 0.8),
    (("openverse.org",), "CC_BY", 0.4),
    (("coverartarchive.org", "archive.org"), "EDITORIAL_LICENSED", 0.6),
    (("scdn.co", "spotifycdn.com"), "EDITORIAL_LICENSED", 0.7),
    (("ytimg.com",), "EDITORIAL_LICENSED", 0.5),
]


def _lookup(tag: Column, place: int, otherwise) -> Column:
    out = F.lit(otherwise)
    for row in LICENSES:
        out = F.when(tag == row[0], F.lit(row[place])).otherwise(out)
    return out


def license_rank(tag: Column) -> Column:
    return _lookup(tag, 1, 99)


def is_open(tag: Column) -> Column:
    return F.coalesce(tag.isin(OPEN), F.lit(False))


def is_context_safe(tag: Column) -> Column:
    return F.coalesce(tag.isin(CONTEXT_SAFE), F.lit(False))


def requires_attribution(tag: Column) -> Column:
    return _lookup(tag, 4, False)


def pretty_license(tag: Column) -> Column:
    return _lookup(tag, 5, None)


def short_license(tag: Column) -> Column:
    out = tag
    for long, short in (("PUBLIC_DOMAIN", "PD"), ("EDITORIAL_LICENSED", "EDITORIAL"), ("PRESS_KIT_ALLOWLIST", "PRESSKIT")):
        out = F.when(tag == long, short).otherwise(out)
    return out


def coerce_license(raw: Column, strict: bool = False) -> Column:
    """Tag of a free-text license; UNKNOWN for null, empty and anything not recognised.

    ``strict`` turns non-commercial and no-derivatives terms into UNKNOWN first.
    """
    s = F.lower(F.trim(raw))
    has = lambda *parts: _any(s.contains(p) for p in parts)
    by_word = s.rlike(r"(?<![A-Za-z0-9_])by(?![A-Za-z0-9_])")
    out = (
        F.when((s == "cc0") | has("public domain dedication", "publicdomain/zero"), "CC0")
        .when(has("public domain", "pdm") | (s == "pd"), "PUBLIC_DOMAIN")
        .when(has("by-sa", "by sa", "sharealike"), "CC_BY_SA")
        .when(has("cc-by", "cc by") | (s == "ccby") | by_word, "CC_BY")
        .when(has("editorial", "spotify", "caa", "itunes"), "EDITORIAL_LICENSED")
        .when(has("press", "promo"), "PRESS_KIT_ALLOWLIST")
        .otherwise("UNKNOWN")
    )
    if strict:
        restricted = s.rlike(r"(?<![a-z])(nc|nd)(?![a-z])") | has("noncommercial", "non-commercial", "noderiv")
        out = F.when(F.coalesce(restricted, F.lit(False)), "UNKNOWN").otherwise(out)
    return out


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def license_from_url(url: Column) -> Column:
    """``struct(license, confidence)`` by the ending of the host."""
    host = host_of(url)
    pair = lambda tag, confidence: F.struct(F.lit(tag).alias("license"), F.lit(float(confidence)).alias("confidence"))
    out = pair("UNKNOWN", 0)
    for endings, tag, confidence in reversed(HOST_LICENSES):
        fits = F.coalesce(_any(host.endswith(e) for e in endings), F.lit(False))
        out = F.when(fits, pair(tag, confidence)).otherwise(out)
    return out


def attribution(tag: Column, author: Column, source_name: Column, source_url: Column, title: Column) -> Column:
    """One line of credit; empty strings count as absent."""
    some = lambda c: F.nullif(c, F.lit(""))
    title, author, name, url = some(title), some(author), some(source_name), some(source_url)
    head = (
        F.when(title.isNotNull(), F.concat_ws(" ", F.concat(F.lit('"'), title, F.lit('"')), F.concat(F.lit("by "), author)))
        .when(author.isNotNull(), F.concat(F.lit("Photo by "), author))
        .otherwise("Photo")
    )
    head = F.concat_ws(" ", head, F.concat(F.lit("("), name, F.lit(")")))
    tail = F.concat_ws(" — ", F.concat(F.lit("licensed "), pretty_license(tag)), url)
    return F.concat(head, F.lit(", "), tail)


def short_attribution(tag: Column, author: Column, source: Column, source_url: Column, title: Column) -> Column:
    """The shorter line of credit: title, author, tag and where it is from."""
    some = lambda c: F.nullif(c, F.lit(""))
    place = F.coalesce(F.concat(F.lit("— "), some(source_url)), F.concat(F.lit("via "), some(source)))
    return F.concat_ws(" ", F.concat(F.lit('"'), some(title), F.lit('"')), F.concat(F.lit("by "), some(author)), F.concat(F.lit("("), tag, F.lit(")")), place)
