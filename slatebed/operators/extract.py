"""Images, links and licenses out of the tags of whole pages."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatebed.functions.license import coerce_license, license_from_url
from slatebed.operators.html import attribute, tags, values_of

_FULL_SIZE = r"(?i)^https?://\S+\.(jpe?g|png|webp|gif|avif)$"
_TRIPLE = r'\[\s*"([^"\[\]]+)"\s*,\s*(\d+)\s*,\s*(\d+)\s*\]'


def resolve_url(src: Column, base: Column) -> Column:
    """Absolute address of a link, null where there is none.

    Whole addresses and paths from the root, which most links are, are put
    together by expressions; only the others are given to Python.
    """
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    whole = src.rlike(r"^https?://[^/?#\s]+(/[^?#\s]*[^?#\s/.]|/[A-Za-z0-9_-]+)$")
    rooted = src.rlike(r"^/[A-Za-z0-9_~-][A-Za-z0-9_~-]*(/[A-Za-z0-9_~-]+)*(\.[A-Za-z0-9]+)?$") & base.rlike("^https?://[^/?#]+")

    def one(s, b):
        try:
            joined = urljoin(b or "", s)
        except (ValueError, TypeError):
            return None
        return joined if "://" in joined else None

    @F.pandas_udf("string")
    def resolved(links: pd.Series, bases: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(links), dtype=object)
        for i in links.index[links.notna()]:
            out[i] = one(links[i], bases[i])
        return out

    odd = F.when(~F.coalesce(whole | rooted, F.lit(False)), src)
    return F.when(whole, src).when(rooted, F.concat(origin, src)).otherwise(resolved(odd, base))


def probe_images(pages: DataFrame) -> DataFrame:
    """``page_id, ordinal, url, width, height, title, license, confidence``; og:image comes first if it is new."""
    read = pages.select("page_id", F.col("url").alias("base"), tags(F.col("html")).alias("tags"))
    number = lambda t, n: F.regexp_extract(attribute(t, n), r"^\s*(\d+)", 1).try_cast("int")
    none = F.lit(None).cast("int")
    images = F.transform(
        F.filter("tags", lambda t: t["kind"] == "img"),
        lambda t, i: F.struct(
            i.cast("long").alias("ordinal"), F.coalesce(attribute(t, "src"), attribute(t, "data-src")).alias("src"), number(t, "width").alias("width"), number(t, "height").alias("height"), attribute(t, "alt").alias("title")
        ),
    )
    hero = F.transform(
        F.slice(values_of(F.col("tags"), "meta", "content", "property", ("og:image",)), 1, 1),
        lambda u: F.struct(F.lit(-1).cast("long").alias("ordinal"), u.alias("src"), none.alias("width"), none.alias("height"), F.lit("og:image").alias("title")),
    )
    every = read.select("page_id", "base", F.inline(F.concat(hero, images)))
    found = every.where("src is not null").withColumn("url", resolve_url(F.col("src"), F.col("base"))).where("url is not null")
    # og:image only if no <img> has the same address
    known = F.count(F.when(F.col("ordinal") >= 0, 1)).over(Window.partitionBy("page_id", "url"))
    guess = license_from_url(F.col("url"))
    return (
        found.withColumn("_known", known)
        .where("ordinal >= 0 or _known = 0")
        .select("page_id", "ordinal", "url", "width", "height", "title", guess["license"].alias("license"), guess["confidence"].alias("confidence"))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, ordinal, href`` of every anchor."""
    return pages.select("page_id", F.posexplode(values_of(tags(F.col("html")), "a", "href")).alias("ordinal", "href"))


def image_triples(html: Column) -> Column:
    """``array<struct<url, width, height>>`` of JSON triples ``["address",width,height]`` that name a full-size image."""
    hits = lambda k: F.regexp_extract_all(html, F.lit(_TRIPLE), k)
    every = F.arrays_zip(hits(1).alias("url"), hits(2).alias("width"), hits(3).alias("height"))
    shaped = F.transform(every, lambda t: F.struct(t["url"].alias("url"), t["width"].try_cast("int").alias("width"), t["height"].try_cast("int").alias("height")))
    return F.filter(shaped, lambda t: t["url"].rlike(_FULL_SIZE) & ~t["url"].contains("gstatic.com") & ~t["url"].contains("google.com/images"))


def serp_triples(pages: DataFrame) -> DataFrame:
    """``page_id, ordinal, url, width, height`` of the triples of a page, first of each address."""
    found = pages.select("page_id", F.posexplode(image_triples(F.col("html"))).alias("ordinal", "t")).select("page_id", "ordinal", "t.*")
    place = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("ordinal"))
    return found.withColumn("_p", place).where("_p = 1").drop("_p")


def page_license(pages: DataFrame) -> DataFrame:
    """License, confidence, license address and author that a page states.

    The first of link rel=license, dc.rights and og:image:license counts if it
    is recognised, else the host's license; the author is article:author.
    """
    read = pages.select("page_id", "url", tags(F.col("html")).alias("tags"))
    first = lambda *place: F.get(values_of(F.col("tags"), *place), F.lit(0))
    raw = F.coalesce(
        first("link", "href", "rel", ("license",)), first("meta", "content", "name", ("dc.rights",)), first("meta", "content", "property", ("og:image:license",))
    )
    told = read.select("page_id", "url", raw.alias("raw"), first("meta", "content", "property", ("article:author",)).alias("author"))
    tag, guess = coerce_license(F.col("raw")), license_from_url(F.col("url"))
    sure = tag != "UNKNOWN"
    return told.select(
        "page_id",
        F.when(sure, tag).otherwise(guess["license"]).alias("license"),
        F.when(sure, F.greatest(guess["confidence"], F.lit(0.7))).otherwise(guess["confidence"]).alias("confidence"),
        F.col("raw").alias("license_url"),
        "author",
    )


def reconciled(page: DataFrame, embedded: DataFrame) -> DataFrame:
    """``page(id, license, confidence, license_url, author)`` with what the file itself says.

    The file's license wins if it is known and as sure at least; its artist
    counts where the page names none.
    """
    e = embedded.select("id", F.col("license").alias("e_license"), F.col("license_confidence").alias("e_sure"), F.col("license_url").alias("e_url"), "artist", "copyright")
    wins = F.coalesce((F.col("e_license") != "UNKNOWN") & (F.col("e_sure") >= F.col("confidence")), F.lit(False))
    return page.join(e, "id", "left").select(
        "id",
        F.when(wins, F.col("e_license")).otherwise(F.col("license")).alias("license"),
        F.when(wins, F.col("e_sure")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(wins, F.coalesce("e_url", "license_url")).otherwise(F.col("license_url")).alias("license_url"),
        F.coalesce(F.nullif("author", F.lit("")), "artist").alias("author"),
        "copyright",
    )


def doc_scores(docs: DataFrame, query: str, most: int = 12) -> DataFrame:
    """Documents that have all terms: 10 for each in the title, 5 in a heading, 1 anywhere."""
    terms = query.lower().split()
    title, body = F.lower("title"), F.lower(F.concat_ws("\n", "title", "body"))
    if not terms:
        return docs.select("doc_id", F.lit(0).alias("score")).where("false")
    headings = F.regexp_extract_all(body, F.lit(r"(?m)^#{2,3}[ \t]+([^\n]+)$"), 1)
    in_heading = lambda t: F.exists(headings, lambda h: h.contains(t))
    score = sum((F.when(title.contains(t), 10).otherwise(0) + F.when(in_heading(t), 5).otherwise(0) + 1 for t in terms), F.lit(0))
    found = docs
    for t in terms:
        found = found.where(body.contains(t))
    return found.select("doc_id", score.cast("int").alias("score")).orderBy(F.desc("score"), "doc_id").limit(most)
