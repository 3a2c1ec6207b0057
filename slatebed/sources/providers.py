"""Provider responses to candidates.

A landed response is a row ``query, source, body`` with the JSON as it came.
Each provider is a :class:`SourceSpec`: the schema to read it by, the array
whose items are candidates, and SQL expressions over an item ``r``. A new
provider is one more entry in ``SPECS``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatebed.dims import CANDIDATE, PROVIDERS
from slatebed.functions.license import coerce_license, license_from_url
from slatebed.functions.values import strip_html

Judge = Callable[[], tuple[Column, Column]]


def fixed(tag: str, confidence: float) -> Judge:
    return lambda: (F.lit(tag), F.lit(confidence))


def coerced(expression: str, sure: float, unsure: float = 0.2) -> Judge:
    def judge():
        tag = coerce_license(F.expr(expression))
        return tag, F.when(tag == "UNKNOWN", unsure).otherwise(sure)

    return judge


def by_host() -> tuple[Column, Column]:
    """By the host of the candidate's address, which is a column by then."""
    guess = license_from_url(F.col("_address"))
    return guess["license"], guess["confidence"]


def declared_or_host(declared: str) -> Judge:
    def judge():
        tag, guess = coerce_license(F.expr(declared)), license_from_url(F.col("_address"))
        sure = tag != "UNKNOWN"
        return F.when(sure, tag).otherwise(guess["license"]), F.when(sure, 0.6).otherwise(guess["confidence"])

    return judge


def archive_rights() -> tuple[Column, Column]:
    url, rights = F.lower(F.expr("r.licenseurl")), F.expr("r.rights")
    read = coerce_license(url)
    tag = (
        F.when(url.contains("publicdomain/zero"), "CC0")
        .when(url.contains("publicdomain"), "PUBLIC_DOMAIN")
        .when(read != "UNKNOWN", read)
        .when(rights.rlike("(?i)public.domain"), "PUBLIC_DOMAIN")
        .otherwise("UNKNOWN")
    )
    return tag, F.when(tag == "UNKNOWN", 0.2).otherwise(0.85)


def library_rights() -> tuple[Column, Column]:
    s = F.lower(F.expr("r.rights"))
    tag = (
        F.when(F.coalesce(s, F.lit("")) == "", "PUBLIC_DOMAIN")
        .when(s.contains("no known restrictions") | s.contains("public domain"), "PUBLIC_DOMAIN")
        .when(s.contains("cc0") | s.contains("publicdomain/zero"), "CC0")
        .otherwise("UNKNOWN")
    )
    return tag, F.when(tag == "PUBLIC_DOMAIN", 0.85).otherwise(0.2)


# License numbers of one photo service.
PHOTO_LICENSES = {
    "1": ("CC_BY_SA", "https://creativecommons.org/licenses/by-nc-sa/2.0/"),
    "2": ("UNKNOWN", "https://creativecommons.org/licenses/by-nc/2.0/"),
    "3": ("UNKNOWN", "https://creativecommons.org/licenses/by-nc-nd/2.0/"),
    "4": ("CC_BY", "https://creativecommons.org/licenses/by/2.0/"),
    "5": ("CC_BY_SA", "https://creativecommons.org/licenses/by-sa/2.0/"),
    "6": ("UNKNOWN", "https://creativecommons.org/licenses/by-nd/2.0/"),
    "7": ("PUBLIC_DOMAIN", "https://www.flickr.com/commons/usage/"),
    "8": ("PUBLIC_DOMAIN", "https://www.usa.gov/government-works"),
    "9": ("CC0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    "10": ("PUBLIC_DOMAIN", "https://creativecommons.org/publicdomain/mark/1.0/"),
}


def _photo(place: int, otherwise: str | None) -> Column:
    out = F.lit(otherwise)
    for number, row in PHOTO_LICENSES.items():
        out = F.when(F.expr("r.license") == number, row[place]).otherwise(out)
    return out


def photo_number() -> tuple[Column, Column]:
    tag = _photo(0, "UNKNOWN")
    return tag, F.lit(0.9)


def collection_id() -> tuple[Column, Column]:
    s = F.lower(F.expr("coalesce(r.thumbnail.license.id, r.locations[0].license.id)"))
    tag = F.when(s == "cc0", "CC0").when(s == "pdm", "PUBLIC_DOMAIN").when(s.isin("cc-by", "cc-by-4.0"), "CC_BY").when(s == "cc-by-sa", "CC_BY_SA").otherwise("UNKNOWN")
    return tag, F.lit(0.9)


CC0_URL = "'https://creativecommons.org/publicdomain/zero/1.0/'"
LARGEST = "array_sort(transform({0}, (x, i) -> struct(-coalesce(x.width, 0) as w, i, x.url as url, x.width as width, x.height as height)))[0]"


@dataclass(frozen=True)
class SourceSpec:
    schema: str
    items: str
    columns: dict[str, str]
    judge: Judge
    where: str = "url is not null"
    only_licensed: bool = False
    most: int | None = None
    tidy: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


_IMG = "array<struct<url:string,width:int,height:int>>"
SPECS: dict[str, SourceSpec] = {
    "wikimedia": SourceSpec(
        "query struct<pages: map<string, struct<pageid:bigint,title:string,imageinfo:array<struct<url:string,thumburl:string,width:int,height:int,mime:string,descriptionurl:string,extmetadata:struct<LicenseShortName:struct<value:string>,License:struct<value:string>,LicenseUrl:struct<value:string>,Artist:struct<value:string>>>>>>>",
        "transform(map_values(j.query.pages), p -> struct(p.title as title, get(p.imageinfo, 0) as i))",
        {"url": "r.i.url", "thumbnail_url": "r.i.thumburl", "width": "r.i.width", "height": "r.i.height", "mime": "r.i.mime", "source_page_url": "r.i.descriptionurl", "title": "regexp_replace(r.title, '^File:', '')", "author": "r.i.extmetadata.Artist.value", "license_url": "r.i.extmetadata.LicenseUrl.value"},
        coerced("coalesce(r.i.extmetadata.LicenseShortName.value, r.i.extmetadata.License.value)", 0.95),
        tidy={"author": strip_html},
    ),
    "openverse": SourceSpec(
        "results array<struct<url:string,thumbnail:string,width:int,height:int,title:string,creator:string,foreign_landing_url:string,detail_url:string,license:string,license_version:string,license_url:string>>",
        "j.results",
        {"url": "r.url", "thumbnail_url": "r.thumbnail", "width": "r.width", "height": "r.height", "source_page_url": "coalesce(r.foreign_landing_url, r.detail_url)", "title": "r.title", "author": "r.creator", "license_url": "r.license_url"},
        coerced("concat_ws(' ', nullif(r.license, ''), nullif(r.license_version, ''))", 0.9),
    ),
    "unsplash": SourceSpec(
        "results array<struct<urls:struct<full:string,regular:string,small:string>,width:int,height:int,links:struct<html:string>,description:string,alt_description:string,user:struct<name:string>>>",
        "j.results",
        {"url": "coalesce(r.urls.full, r.urls.regular)", "thumbnail_url": "r.urls.small", "width": "r.width", "height": "r.height", "source_page_url": "r.links.html", "title": "coalesce(r.description, r.alt_description)", "author": "r.user.name", "license_url": "'https://unsplash.com/license'"},
        fixed("CC0", 0.85),
    ),
    "pexels": SourceSpec(
        "photos array<struct<src:struct<original:string,medium:string>,width:int,height:int,url:string,alt:string,photographer:string>>",
        "j.photos",
        {"url": "r.src.original", "thumbnail_url": "r.src.medium", "width": "r.width", "height": "r.height", "source_page_url": "r.url", "title": "r.alt", "author": "r.photographer", "license_url": "'https://www.pexels.com/license/'"},
        fixed("CC0", 0.85),
    ),
    "pixabay": SourceSpec(
        "hits array<struct<largeImageURL:string,webformatURL:string,previewURL:string,imageWidth:int,imageHeight:int,pageURL:string,user:string>>",
        "j.hits",
        {"url": "coalesce(r.largeImageURL, r.webformatURL)", "thumbnail_url": "r.previewURL", "width": "r.imageWidth", "height": "r.imageHeight", "source_page_url": "r.pageURL", "author": "r.user", "license_url": "'https://pixabay.com/service/license-summary/'"},
        fixed("CC0", 0.85),
    ),
    "itunes": SourceSpec(
        "results array<struct<artistName:string,collectionName:string,collectionViewUrl:string,artistViewUrl:string,artworkUrl100:string,artworkUrl60:string>>",
        "j.results",
        {"url": r"regexp_replace(coalesce(r.artworkUrl100, r.artworkUrl60), '/\\d+x\\d+bb\\.(jpg|png)', '/1200x1200bb.$1')", "thumbnail_url": "coalesce(r.artworkUrl100, r.artworkUrl60)", "width": "1200", "height": "1200", "source_page_url": "coalesce(r.collectionViewUrl, r.artistViewUrl)", "title": "coalesce(r.collectionName, r.artistName)", "author": "r.artistName", "license_url": "'https://www.apple.com/legal/internet-services/itunes/'"},
        fixed("EDITORIAL_LICENSED", 0.8),
    ),
    "musicbrainz-caa": SourceSpec(
        "releases array<struct<id:string,title:string,`artist-credit`:array<struct<name:string>>>>",
        "j.releases",
        {"url": "concat('https://coverartarchive.org/release/', r.id, '/front')", "thumbnail_url": "concat('https://coverartarchive.org/release/', r.id, '/front-250')", "source_page_url": "concat('https://musicbrainz.org/release/', r.id)", "title": "r.title", "author": "get(r.`artist-credit`, 0).name", "license_url": "'https://musicbrainz.org/doc/Cover_Art_Archive'"},
        fixed("EDITORIAL_LICENSED", 0.75),
        most=10,
    ),
    "spotify": SourceSpec(
        f"artists struct<items:array<struct<name:string,external_urls:struct<spotify:string>,images:{_IMG}>>>, albums struct<items:array<struct<name:string,external_urls:struct<spotify:string>,artists:array<struct<name:string>>,images:{_IMG}>>>",
        "concat(coalesce(transform(j.artists.items, a -> struct(a.name as title, a.name as author, a.external_urls.spotify as page, a.images as images)), array()), coalesce(transform(j.albums.items, a -> struct(a.name as title, get(a.artists, 0).name as author, a.external_urls.spotify as page, a.images as images)), array()))",
        {"url": LARGEST.format("r.images") + ".url", "width": LARGEST.format("r.images") + ".width", "height": LARGEST.format("r.images") + ".height", "source_page_url": "r.page", "title": "r.title", "author": "r.author", "license_url": "'https://developer.spotify.com/policy'"},
        fixed("EDITORIAL_LICENSED", 0.8),
        where="size(r.images) > 0",
    ),
    "brave": SourceSpec(
        "results array<struct<url:string,title:string,properties:struct<url:string,width:int,height:int>,thumbnail:struct<src:string>>>",
        "j.results",
        {"url": "coalesce(r.properties.url, r.thumbnail.src, r.url)", "thumbnail_url": "r.thumbnail.src", "width": "r.properties.width", "height": "r.properties.height", "source_page_url": "r.url", "title": "r.title"},
        by_host,
    ),
    "bing": SourceSpec(
        "value array<struct<contentUrl:string,thumbnailUrl:string,width:int,height:int,hostPageUrl:string,name:string,license:string,insightsMetadata:struct<license:string>>>",
        "j.value",
        {"url": "r.contentUrl", "thumbnail_url": "r.thumbnailUrl", "width": "r.width", "height": "r.height", "source_page_url": "r.hostPageUrl", "title": "r.name"},
        declared_or_host("coalesce(r.insightsMetadata.license, r.license)"),
    ),
    "serpapi": SourceSpec(
        "images_results array<struct<original:string,thumbnail:string,original_width:int,original_height:int,link:string,title:string,source:string>>",
        "j.images_results",
        {"url": "coalesce(r.original, r.thumbnail)", "thumbnail_url": "r.thumbnail", "width": "r.original_width", "height": "r.original_height", "source_page_url": "r.link", "title": "r.title", "author": "r.source"},
        by_host,
        most=10,
    ),
    "flickr": SourceSpec(
        "stat string, photos struct<photo:array<struct<id:string,owner:string,ownername:string,title:string,license:string,url_o:string,url_l:string,url_c:string,url_z:string>>>",
        "if(j.stat = 'ok', j.photos.photo, null)",
        {"url": "coalesce(r.url_o, r.url_l, r.url_c, r.url_z)", "thumbnail_url": "r.url_z", "source_page_url": "concat('https://www.flickr.com/photos/', r.owner, '/', r.id)", "title": "r.title", "author": "r.ownername"},
        photo_number,
        only_licensed=True,
    ),
    "internet-archive": SourceSpec(
        "response struct<docs:array<struct<identifier:string,title:string,creator:string,licenseurl:string,rights:string>>>",
        "j.response.docs",
        {"url": "concat('https://archive.org/services/img/', r.identifier)", "thumbnail_url": "concat('https://archive.org/services/img/', r.identifier)", "source_page_url": "concat('https://archive.org/details/', r.identifier)", "title": "r.title", "author": "coalesce(array_join(from_json(if(r.creator like '[%', r.creator, null), 'array<string>'), ', '), r.creator)", "license_url": "r.licenseurl"},
        archive_rights,
        where="r.identifier is not null",
    ),
    "smithsonian": SourceSpec(
        "response struct<rows:array<struct<title:string,url:string,content:struct<descriptiveNonRepeating:struct<record_link:string,title:struct<content:string>,online_media:struct<media:array<struct<type:string,content:string,thumbnail:string>>>>,freetext:struct<name:array<struct<content:string>>>>>>>",
        "transform(j.response.rows, x -> struct(x as d, get(filter(x.content.descriptiveNonRepeating.online_media.media, m -> m.type = 'Images' and coalesce(m.content, m.thumbnail) is not null), 0) as m))",
        {"url": "coalesce(r.m.content, r.m.thumbnail)", "thumbnail_url": "r.m.thumbnail", "source_page_url": "coalesce(r.d.content.descriptiveNonRepeating.record_link, r.d.url)", "title": "coalesce(r.d.title, r.d.content.descriptiveNonRepeating.title.content)", "author": "get(r.d.content.freetext.name, 0).content", "license_url": CC0_URL},
        fixed("CC0", 0.95),
    ),
    "nasa": SourceSpec(
        "collection struct<items:array<struct<data:array<struct<nasa_id:string,title:string,photographer:string,secondary_creator:string,center:string>>,links:array<struct<href:string,render:string>>>>>",
        "transform(j.collection.items, x -> struct(get(x.data, 0) as d, coalesce(get(filter(x.links, l -> l.render = 'image'), 0), get(x.links, 0)) as l))",
        {"url": "r.l.href", "thumbnail_url": "r.l.href", "source_page_url": "concat('https://images.nasa.gov/details/', r.d.nasa_id)", "title": "r.d.title", "author": "coalesce(r.d.photographer, r.d.secondary_creator, r.d.center)", "license_url": "'https://www.nasa.gov/nasa-brand-center/images-and-media/'"},
        fixed("PUBLIC_DOMAIN", 0.95),
    ),
    "europeana": SourceSpec(
        "items array<struct<guid:string,title:array<string>,dcCreator:array<string>,edmIsShownBy:array<string>,edmIsShownAt:array<string>,edmPreview:array<string>,rights:array<string>>>",
        "j.items",
        {"url": "coalesce(get(r.edmIsShownBy, 0), get(r.edmPreview, 0))", "thumbnail_url": "get(r.edmPreview, 0)", "source_page_url": "coalesce(r.guid, get(r.edmIsShownAt, 0))", "title": "get(r.title, 0)", "author": "get(r.dcCreator, 0)", "license_url": "get(r.rights, 0)"},
        coerced("get(r.rights, 0)", 0.85),
        only_licensed=True,
    ),
    "europeana-archival": SourceSpec(
        "items array<struct<guid:string,title:array<string>,dcCreator:array<string>,edmIsShownAt:array<string>,edmPreview:array<string>,rights:array<string>>>",
        "j.items",
        {"url": "get(r.edmPreview, 0)", "thumbnail_url": "get(r.edmPreview, 0)", "source_page_url": "coalesce(r.guid, get(r.edmIsShownAt, 0))", "title": "get(r.title, 0)", "author": "get(r.dcCreator, 0)", "license_url": "get(r.rights, 0)"},
        coerced("get(r.rights, 0)", 0.8),
        only_licensed=True,
    ),
    "library-of-congress": SourceSpec(
        "results array<struct<id:string,url:string,title:string,image_url:array<string>,rights:string,contributor:array<string>>>",
        "j.results",
        {"url": "reduce(r.image_url, get(r.image_url, 0), (a, b) -> if(length(b) > length(a), b, a))", "thumbnail_url": "reduce(r.image_url, get(r.image_url, 0), (a, b) -> if(length(b) > length(a), b, a))", "source_page_url": "coalesce(r.url, r.id)", "title": "r.title", "author": "get(r.contributor, 0)", "license_url": "r.rights"},
        library_rights,
    ),
    "wellcome-collection": SourceSpec(
        "results array<struct<id:string,thumbnail:struct<url:string,license:struct<id:string>>,locations:array<struct<url:string,license:struct<id:string,url:string>>>,source:struct<id:string,title:string,contributors:array<struct<agent:struct<label:string>>>>>>",
        "j.results",
        {"url": "coalesce(get(r.locations, 0).url, r.thumbnail.url)", "thumbnail_url": "r.thumbnail.url", "source_page_url": "concat('https://wellcomecollection.org/works/', coalesce(r.source.id, r.id))", "title": "r.source.title", "author": "nullif(array_join(filter(transform(r.source.contributors, c -> c.agent.label), a -> a <> ''), ', '), '')", "license_url": "get(r.locations, 0).license.url"},
        collection_id,
        only_licensed=True,
    ),
    "rawpixel": SourceSpec(
        "results array<struct<title:string,image_md:string,image_1300:string,image:string,pageURL:string,url:string,user:struct<display_name:string,username:string>>>",
        "j.results",
        {"url": "coalesce(r.image_1300, r.image_md, r.image)", "thumbnail_url": "coalesce(r.image_md, r.image_1300, r.image)", "source_page_url": "coalesce(r.pageURL, r.url)", "title": "r.title", "author": "coalesce(r.user.display_name, r.user.username)", "license_url": CC0_URL},
        fixed("CC0", 0.9),
    ),
    "similar": SourceSpec(
        "image_results array<struct<link:string,thumbnail:string,title:string>>",
        "j.image_results",
        {"url": "coalesce(r.thumbnail, r.link)", "source_page_url": "r.link", "title": "r.title"},
        by_host,
    ),
    "burst": SourceSpec(
        "photos array<struct<title:string,image_url:string,thumbnail_url:string,permalink:string,page_url:string,photographer:struct<name:string>>>, results array<struct<title:string,image_url:string,thumbnail_url:string,permalink:string,page_url:string,photographer:struct<name:string>>>",
        "coalesce(j.photos, j.results)",
        {"url": "r.image_url", "thumbnail_url": "coalesce(r.thumbnail_url, r.image_url)", "source_page_url": "coalesce(r.permalink, r.page_url)", "title": "r.title", "author": "r.photographer.name", "license_url": CC0_URL},
        fixed("CC0", 0.95),
        most=10,
    ),
}


def candidates_of(responses: DataFrame, source: str, specs: dict[str, SourceSpec] = SPECS) -> DataFrame:
    """Candidates of one source's responses; bodies that are no such JSON give none."""
    spec = specs[source]
    rows = responses.where(F.col("source") == source).select("query", F.from_json("body", spec.schema).alias("j"))
    items = F.expr(spec.items)
    if spec.most:
        items = F.slice(items, 1, spec.most)
    each = rows.select("query", F.posexplode(items).alias("at", "r")).withColumn("_address", F.expr(spec.columns["url"]))
    tag, confidence = spec.judge()
    values = {c: F.expr(e) for c, e in spec.columns.items()} | {"source": F.lit(source), "ordinal": F.col("at").cast("long"), "query": F.col("query"), "license": tag, "confidence": confidence}
    if source == "flickr":
        values["license_url"] = _photo(1, None)
    values |= {c: f(values[c]) for c, f in spec.tidy.items()}
    shaped = each.withColumns({f"_{f.name}": values.get(f.name, F.lit(None)).cast(f.dataType) for f in CANDIDATE})
    kept = shaped.where(spec.where.replace("url is", "_url is"))
    if spec.only_licensed:
        kept = kept.where("_license <> 'UNKNOWN'")
    return kept.select(*(F.col(f"_{f.name}").alias(f.name) for f in CANDIDATE))


def museum_candidates(searches: DataFrame, details: DataFrame) -> DataFrame:
    """Two-step source: ids of a search joined with the landed object of each id."""
    ids = searches.select("query", F.posexplode(F.from_json("body", "total bigint, objectIDs array<bigint>")["objectIDs"]).alias("at", "id"))
    d = details.select(F.from_json("body", "objectID bigint, isPublicDomain boolean, primaryImage string, primaryImageSmall string, title string, artistDisplayName string, objectURL string").alias("d")).select("d.*")
    found = ids.join(d, F.col("id") == F.col("objectID")).where("isPublicDomain and primaryImage <> ''")
    values = {"query": F.col("query"), "ordinal": F.col("at"), "url": F.col("primaryImage"), "thumbnail_url": F.col("primaryImageSmall"), "source": F.lit("met-museum"), "source_page_url": F.col("objectURL"), "title": F.col("title"), "author": F.col("artistDisplayName"), "license": F.lit("CC0"), "license_url": F.expr(CC0_URL), "confidence": F.lit(0.95)}
    return found.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANDIDATE))


def video_thumbnails(queries: DataFrame) -> DataFrame:
    """Three sizes for each query that is a video id or a video's address."""
    q = F.col("query")
    bare = F.when(q.rlike("^[A-Za-z0-9_-]{11}$"), q)
    short = F.nullif(F.regexp_extract(q, r"^https?://(?:www\.)?youtu\.be/([^?#]*)", 1), F.lit(""))
    long = F.nullif(F.regexp_extract(q, r"^https?://[^/]*youtube\.com/[^#]*[?&]v=([^&#]+)", 1), F.lit(""))
    sizes = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("w"), F.lit(h).alias("h")) for n, w, h in (("maxresdefault", 1280, 720), ("sddefault", 640, 480), ("hqdefault", 480, 360))))
    found = queries.withColumn("id", F.coalesce(bare, short, long)).where("id is not null").select("query", "id", F.posexplode(sizes).alias("at", "s"))
    values = {"query": F.col("query"), "ordinal": F.col("at"), "url": F.format_string("https://i.ytimg.com/vi/%s/%s.jpg", "id", "s.name"), "width": F.col("s.w"), "height": F.col("s.h"), "source": F.lit("youtube-thumb"), "source_page_url": F.concat(F.lit("https://www.youtube.com/watch?v="), "id"), "title": F.format_string("YouTube thumbnail (%s)", "s.name"), "license": F.lit("EDITORIAL_LICENSED"), "confidence": F.lit(0.6)}
    return found.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANDIDATE))


def default_sources() -> list[str]:
    return [row[0] for row in PROVIDERS if row[2]]
