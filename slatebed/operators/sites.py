"""Image extractors for kinds of pages, each a list of places to look at in order of preference."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatebed.functions.urls import host_of
from slatebed.operators.extract import image_triples, resolve_url
from slatebed.operators.html import pictures, tags, urls_in, values_of

_IMAGE_ENDING = r"(?i)\.(jpe?g|png|webp|gif|avif)([?#]|$)"


@dataclass(frozen=True)
class Branch:
    """Addresses from a page's text and tags, and what they are worth."""

    find: Callable[[Column, Column], Column]
    title: str | None = None
    confidence: float = 0.0
    fits: Callable[[Column], Column] = lambda url: F.lit(True)
    tidy: Callable[[Column], Column] = lambda url: url
    only_if_none: bool = False
    first_only: bool = False


def _tag(kind: str, value: str, where: str | None = None, *one_of: str) -> Callable[[Column, Column], Column]:
    return lambda html, found: values_of(found, kind, value, where, one_of)


def _on_host(*hosts: str) -> Callable[[Column], Column]:
    return lambda url: F.coalesce(host_of(url).isin(*hosts), F.lit(False))


def _original_size(url: Column) -> Column:
    """A pin's address with its first folder, a size, replaced."""
    parts = F.split(url, "/")
    sized = F.get(parts, F.lit(3)).rlike(r"^\d+x\d*$")
    return F.when(sized, F.array_join(F.concat(F.slice(parts, 1, 3), F.array(F.lit("originals")), F.slice(parts, 5, 1000)), "/")).otherwise(url)


def _original_name(url: Column) -> Column:
    """A post's image with the parameter ``name`` set to orig."""
    base, query = F.substring_index(url, "?", 1), F.when(url.contains("?"), F.substring_index(url, "?", -1))
    named = F.transform(F.split(query, "&"), lambda p: F.when(p.startswith("name="), F.lit("name=orig")).otherwise(p))
    every = F.when(F.exists(named, lambda p: p == "name=orig"), named).otherwise(F.concat(named, F.array(F.lit("name=orig"))))
    return F.concat(base, F.lit("?"), F.coalesce(F.array_join(every, "&"), F.lit("name=orig")))


_OG = Branch(_tag("meta", "content", "property", "og:image"), "og:image", first_only=True)
GENERIC = [
    Branch(_tag("meta", "content", "property", "og:image", "og:image:url"), "og:image", 0.2),
    Branch(_tag("meta", "content", "name", "twitter:image"), "twitter:image", 0.15),
    Branch(_tag("link", "href", "rel", "image_src"), "image_src"),
    Branch(lambda html, found: pictures(found), fits=lambda url: ~url.startswith("data:")),
    Branch(_tag("a", "href"), "linked", 0.1, fits=lambda url: url.rlike(_IMAGE_ENDING)),
]
IMAGE_RESULTS = [
    Branch(lambda html, found: F.transform(image_triples(html), lambda t: t["url"])),
    Branch(
        lambda html, found: F.filter(values_of(found, "a", "href"), lambda u: u.startswith("/imgres?")),
        fits=lambda url: url.rlike("[?&]imgurl="),
        tidy=lambda url: F.try_url_decode(F.regexp_extract(url, "[?&]imgurl=([^&]*)", 1)),
    ),
    Branch(lambda html, found: pictures(found), fits=lambda url: url.rlike("^(?i)https?://") & ~url.contains("gstatic.com/images/branding"), only_if_none=True),
]
PINS = [Branch(lambda html, found: urls_in(html), fits=lambda url: _on_host("i.pinimg.com")(url) & url.rlike(_IMAGE_ENDING), tidy=_original_size), _OG]
POSTS = [
    Branch(lambda html, found: urls_in(html), fits=lambda url: _on_host("pbs.twimg.com")(url) & url.contains("/media/"), tidy=_original_name),
    _OG,
]


def site_images(pages: DataFrame, branches: list[Branch]) -> DataFrame:
    """``page_id, branch, ordinal, url, title, confidence``: each address once a page, the first in order.

    A page is read once: its tags, and all places of them, are arrays of its row.
    """
    read = pages.select("page_id", F.col("url").alias("base"), F.replace("html", F.lit("&amp;"), F.lit("&")).alias("html"))
    read = read.withColumn("tags", tags(F.col("html")))
    hits = [F.filter(b.find(F.col("html"), F.col("tags")), b.fits) for b in branches]
    found = read.select("page_id", "base", *((F.slice(h, 1, 1) if b.first_only else h).alias(f"b{i}") for i, (b, h) in enumerate(zip(branches, hits))))
    usual = F.array(*(F.size(f"b{i}") for i, b in enumerate(branches) if not b.only_if_none))
    lists = []
    for i, b in enumerate(branches):
        branch = F.lit(i).alias("branch")
        rows = F.transform(f"b{i}", lambda u, j: F.struct(branch, j.alias("ordinal"), u.alias("src")))  # noqa: B023
        lists.append(F.when(F.array_max(usual) == 0, rows).otherwise(F.slice(rows, 1, 0)) if b.only_if_none else rows)
    each = found.select("page_id", "base", F.inline(F.flatten(F.array(*lists))))
    pick = lambda value: _by_branch([value(b) for b in branches])
    tidied = each.select("*", pick(lambda b: b.tidy(F.col("src"))).alias("tidy"), pick(lambda b: F.lit(b.title).cast("string")).alias("title"), pick(lambda b: F.lit(b.confidence)).alias("confidence"))
    # posts with two sizes of an image keep both, as what is compared is the address on the page
    key = "src" if branches is POSTS else "url"
    placed = tidied.withColumn("url", F.when(F.col("tidy").rlike("^https?://"), F.col("tidy")).otherwise(resolve_url(F.col("tidy"), F.col("base")))).where("url is not null")
    place = F.row_number().over(Window.partitionBy("page_id", key).orderBy("branch", "ordinal"))
    return placed.withColumn("_p", place).where("_p = 1").select("page_id", "branch", "ordinal", "url", "title", "confidence")


def _by_branch(values: list[Column]) -> Column:
    out = values[-1]
    for i in range(len(values) - 2, -1, -1):
        out = F.when(F.col("branch") == i, values[i]).otherwise(out)
    return out


def result_page_images(pages: DataFrame, site: str) -> DataFrame:
    """``page_id, ordinal, url, source_page_url, title``: plausible images of a rendered result page.

    site is "google" or "pinterest". The page of an image is the last link before it.
    """
    read = pages.select("page_id", F.posexplode(tags(F.col("html"))).alias("ordinal", "tag"))
    value = lambda n: F.nullif(F.get("tag.values", (F.array_position("tag.names", n) - 1).cast("int")), F.lit(""))
    before = Window.partitionBy("page_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    link = F.last(F.when(F.col("tag.kind") == "a", value("href")), ignorenulls=True).over(before)
    rows = read.select("page_id", "ordinal", "tag.kind", value("src").alias("url"), value("alt").alias("title"), link.alias("link"))
    url = F.lower("url")
    noise = url.rlike("/(spinner|loading|sprite|favicon|gstatic/images/branding)") | url.rlike("[?&](w|width)=1([^0-9a-z_]|$)") | F.col("url").endswith(".svg")
    served = url.rlike("encrypted-tbn|gstatic[.]com/images|googleusercontent[.]com") | url.rlike(r"[.](jpe?g|png|webp|gif)([?]|$)")
    plausible = ~noise & (served if site == "google" else url.contains("pinimg.com"))
    page = F.when(F.col("link").rlike("^https?://"), F.col("link"))
    if site == "pinterest":
        page = F.coalesce(page, F.when(F.col("link").startswith("/pin/"), F.concat(F.lit("https://www.pinterest.com"), "link")))
    images = rows.where((F.col("kind") == "img") & url.rlike("^https?://") & plausible)
    place = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("ordinal"))
    return images.withColumn("_p", place).where("_p = 1").select("page_id", "ordinal", "url", page.alias("source_page_url"), "title")


def extractor_of(url: Column) -> Column:
    """Which of the extractors a page's host calls for."""
    host = host_of(url)
    kind = (
        F.when(host.rlike(r"(^|\.)google\.com$"), "google-images")
        .when(host.rlike(r"(^|\.)pinterest\.[a-z.]+$"), "pinterest")
        .when(host.rlike(r"(^|\.)(twitter|x)\.com$"), "twitter")
    )
    return F.coalesce(kind, F.lit("generic-page"))
