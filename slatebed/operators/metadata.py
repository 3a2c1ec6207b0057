"""Credit and license inside image files: EXIF, IPTC and XMP of JPEG and TIFF bytes."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatebed.functions.license import coerce_license

# TIFF tags and IPTC data sets that are read.
TIFF_TAGS = {0x010E: "description", 0x013B: "artist", 0x8298: "copyright"}
IPTC_SETS = {80: "artist", 116: "copyright", 118: "contact"}
FIELDS = ["exif_artist", "exif_copyright", "exif_description", "iptc_artist", "iptc_copyright", "xmp"]


def _text(data: bytes, trim: bool) -> str:
    text = data.decode("utf-8", "replace")
    return text.strip() if trim else text


def tiff_strings(data: bytes, trim: bool = True) -> dict[str, str]:
    """The ASCII tags of the first directory; nothing for bytes that are no TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    found: dict[str, str] = {}
    if not order or len(data) < 8:
        return found
    (at,) = struct.unpack_from(order + "I", data, 4)
    if at + 2 > len(data):
        return found
    (entries,) = struct.unpack_from(order + "H", data, at)
    for i in range(entries):
        where = at + 2 + 12 * i
        if where + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", data, where)
        if tag in TIFF_TAGS and kind == 2:
            start = where + 8 if count <= 4 else struct.unpack_from(order + "I", data, where + 8)[0]
            text = _text(data[start : start + count].split(b"\0")[0], trim)
            if text:
                found.setdefault(TIFF_TAGS[tag], text)
    return found


def iptc_strings(data: bytes, trim: bool = True) -> dict[str, str]:
    """Data sets of record 2, wherever they are in a block."""
    found: dict[str, str] = {}
    at = 0
    while (at := data.find(b"\x1c\x02", at)) >= 0 and at + 5 <= len(data):
        kind, size = data[at + 2], int.from_bytes(data[at + 3 : at + 5], "big")
        text = _text(data[at + 5 : at + 5 + size], trim)
        if kind in IPTC_SETS and text:
            found.setdefault(IPTC_SETS[kind], text)
        at += 5 + size
    return found


def file_parts(data: bytes, trim: bool = True) -> dict[str, str | None]:
    """EXIF and IPTC strings and the XMP packet of a file; broken files give what could be read.

    ``trim`` takes blanks off the ends of EXIF and IPTC strings.
    """
    out: dict[str, str | None] = dict.fromkeys(FIELDS)

    def put(prefix: str, found: dict[str, str]) -> None:
        for k, v in found.items():
            if f"{prefix}_{k}" in out and not out[f"{prefix}_{k}"]:
                out[f"{prefix}_{k}"] = v

    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, marker = data[at + 4 : at + 2 + size], data[at + 1]
            if marker == 0xE1 and body.startswith(b"Exif\0\0"):
                put("exif", tiff_strings(body[6:], trim))
            elif marker == 0xE1 and b"<" in body and out["xmp"] is None and b"xmp" in body[:64].lower() + body[-400:].lower():
                out["xmp"] = body[body.index(b"<") :].decode("utf-8", "replace")
            elif marker == 0xED:
                put("iptc", iptc_strings(body, trim))
            at += 2 + max(size, 2)
    else:
        put("exif", tiff_strings(data, trim))
        if packet := re.search(rb"<x:xmpmeta.*?</x:xmpmeta>", data, re.S):
            out["xmp"] = packet[0].decode("utf-8", "replace")
    return out


def file_fields(content: Column, trim: bool = True) -> Column:
    """The strings of FIELDS of each file; see :func:`file_parts`."""

    @F.pandas_udf(", ".join(f"{f} string" for f in FIELDS))
    def read(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict.fromkeys(FIELDS) if b is None else file_parts(bytes(b), trim) for b in column], columns=FIELDS)

    return read(content)


def _inner(xml: Column, tag: str) -> Column:
    block = F.regexp_extract(xml, rf"(?is)<{tag}[\s>].*?</{tag}>", 0)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(block, "<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def _resource(xml: Column, tag: str) -> Column:
    return F.nullif(F.regexp_extract(xml, rf"""(?i)<{tag}\b[^>]*?rdf:resource=["']([^"']+)["']""", 1), F.lit(""))


def embedded_metadata(blobs: DataFrame, trim: bool = True) -> DataFrame:
    """``blobs(id, content)`` to artist, copyright, description, license and how sure each is.

    The first of EXIF, IPTC and XMP that has an artist or a copyright gives it;
    without ``trim`` EXIF and IPTC give it as it stands in the file.
    """
    p = blobs.select("id", file_fields(F.col("content"), trim).alias("p")).select("id", "p.*")
    xml = F.col("xmp")
    x = p.select(
        "*",
        _inner(xml, "dc:creator").alias("x_artist"),
        _inner(xml, "dc:rights").alias("x_rights"),
        _inner(xml, "xmpRights:UsageTerms").alias("x_terms"),
        F.coalesce(_resource(xml, "xmpRights:WebStatement"), _inner(xml, "xmpRights:WebStatement")).alias("web_statement"),
        F.coalesce(_resource(xml, "cc:license"), _inner(xml, "cc:license")).alias("x_license"),
    )
    told = F.array("x_license", "x_terms", "web_statement", "x_rights")
    best = F.get(F.filter(F.transform(told, lambda t, i: F.struct(t.alias("text"), coerce_license(t).alias("tag"), i.alias("i"))), lambda c: c["tag"] != "UNKNOWN"), F.lit(0))
    first = lambda *pairs: F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(v)) for c, v in pairs), F.lit(0.0))
    is_url = lambda c: F.when(c.rlike("^https?://"), c)
    y = x.withColumn("best", best)
    return y.select(
        "id",
        F.coalesce("exif_artist", "iptc_artist", "x_artist").alias("artist"),
        F.coalesce("exif_copyright", "iptc_copyright", "x_rights").alias("copyright"),
        F.col("exif_description").alias("description"),
        F.coalesce("best.tag", F.lit("UNKNOWN")).alias("license"),
        F.coalesce(is_url(F.col("best.text")), is_url(F.col("x_license"))).alias("license_url"),
        "web_statement",
        first(("exif_artist", 0.7), ("iptc_artist", 0.8), ("x_artist", 0.9)).alias("artist_confidence"),
        first(("exif_copyright", 0.7), ("iptc_copyright", 0.8), ("x_rights", 0.9)).alias("copyright_confidence"),
        F.when(F.col("best").isNull(), 0.0).when(F.col("best.text") == F.col("x_license"), 0.95).otherwise(0.8).alias("license_confidence"),
    )
