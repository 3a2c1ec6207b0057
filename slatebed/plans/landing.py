"""The documents as responses of the sources, and what is to be read out of them.

A page of a source is twelve documents. ``item`` is the JSON of one in the
shape in which the source delivers it, ``before`` and ``after`` stand around
the items of a page. What a candidate has to be is told by expressions over the
documents themselves, for Spark and DuckDB alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatebed.plans.inputs import CANDIDATES_SQL, candidates

#: Documents of a page.
PAGE = 12
#: Statements that are read as the license of a candidate; its address; its name in a library; a host that gives it away.
STATED = "case license when 'CC0' then 'Public domain dedication' when 'PUBLIC_DOMAIN' then 'Public Domain' when 'CC_BY' then 'CC BY 4.0' when 'CC_BY_SA' then 'CC BY-SA 4.0' when 'EDITORIAL_LICENSED' then 'Editorial use' when 'PRESS_KIT_ALLOWLIST' then 'Press photo' else 'in copyright' end"
DEED = "case license when 'CC0' then 'http://creativecommons.org/publicdomain/zero/1.0/' when 'PUBLIC_DOMAIN' then 'http://creativecommons.org/publicdomain/mark/1.0/ public domain' when 'CC_BY' then 'http://creativecommons.org/licenses/by/4.0/' when 'CC_BY_SA' then 'http://creativecommons.org/licenses/by-sa/4.0/' end"
HOSTED = "'https://' || case license when 'CC0' then 'images.pexels.com' when 'CC_BY' then 'api.openverse.org' when 'CC_BY_SA' then 'upload.wikimedia.org' when 'EDITORIAL_LICENSED' then 'i.scdn.co' when 'PUBLIC_DOMAIN' then 'i.ytimg.com' when 'UNKNOWN' then 'live.staticflickr.com' else 'example.org' end || '/' || ordinal || '.jpg'"
_BY_HOST = {
    "license": "case license when 'CC0' then 'CC0' when 'CC_BY' then 'CC_BY' when 'CC_BY_SA' then 'CC_BY_SA' when 'EDITORIAL_LICENSED' then 'EDITORIAL_LICENSED' when 'PUBLIC_DOMAIN' then 'EDITORIAL_LICENSED' else 'UNKNOWN' end",
    "confidence": "case license when 'CC0' then 0.8 when 'CC_BY' then 0.4 when 'CC_BY_SA' then 0.4 when 'EDITORIAL_LICENSED' then 0.7 when 'PUBLIC_DOMAIN' then 0.5 when 'UNKNOWN' then 0.1 else 0.0 end",
}
_DEEDS = "license in ('CC0', 'PUBLIC_DOMAIN', 'CC_BY', 'CC_BY_SA')"


@dataclass(frozen=True)
class Landed:
    item: str
    before: str
    after: str
    license: str
    confidence: str
    url: str = "url"
    title: str = "title"
    author: str = "author"
    where: str = "true"
    #: Items of a page that the source's reader takes.
    most: int = PAGE


def _record(fields: str) -> str:
    return f"to_json(named_struct({fields}))"


def _sure(confidence: float) -> str:
    return f"case when license = 'UNKNOWN' then 0.2 else {confidence} end"


_EVEN = "coalesce(width, 0) % 2 = 0"
LANDED = {
    "wikimedia": Landed(
        f"concat('\"', ordinal, '\":', {_record(f"'pageid', ordinal, 'title', concat('File:', title), 'imageinfo', array(named_struct('url', url, 'width', width, 'height', height, 'extmetadata', named_struct('LicenseShortName', named_struct('value', {STATED}), 'Artist', named_struct('value', concat('<b>', author, '</b>')))))")})",
        '{"query":{"pages":{', "}}}", "license", _sure(0.95), author="nullif(author, '')",
    ),
    "openverse": Landed(_record(f"'url', url, 'title', title, 'creator', author, 'license', {STATED}, 'license_version', if({_EVEN}, '4.0', '')"), '{"results":[', "]}", "license", _sure(0.9)),
    "unsplash": Landed(_record(f"'urls', named_struct('full', if({_EVEN}, url, null), 'regular', concat(url, 'r')), 'alt_description', title, 'user', named_struct('name', author)"), '{"results":[', "]}", "'CC0'", "0.85", url=f"case when {_EVEN} then url else url || 'r' end"),
    "pexels": Landed(_record("'src', named_struct('original', url), 'photographer', author, 'alt', title, 'width', width"), '{"photos":[', "]}", "'CC0'", "0.85"),
    "pixabay": Landed(_record(f"'largeImageURL', if({_EVEN}, url, null), 'webformatURL', concat(url, 'w'), 'user', author"), '{"total":1,"hits":[', "]}", "'CC0'", "0.85", url=f"case when {_EVEN} then url else url || 'w' end", title="null"),
    "itunes": Landed(_record("'artistName', coalesce(author, 'none'), 'collectionName', title, 'artworkUrl100', concat('https://a.example/', ordinal, '/100x100bb.jpg')"), '{"results":[', "]}", "'EDITORIAL_LICENSED'", "0.8", url="'https://a.example/' || ordinal || '/1200x1200bb.jpg'", title="coalesce(title, author, 'none')", author="coalesce(author, 'none')"),
    "musicbrainz-caa": Landed(_record("'id', concat('r', ordinal), 'title', title, 'artist-credit', array(named_struct('name', author), named_struct('name', 'x'))"), '{"releases":[', "]}", "'EDITORIAL_LICENSED'", "0.75", url="'https://coverartarchive.org/release/r' || ordinal || '/front'", most=10),
    "spotify": Landed(_record("'name', title, 'artists', array(named_struct('name', author)), 'images', array(named_struct('url', concat(url, 's'), 'width', 640), named_struct('url', url, 'width', width))"), '{"artists":{"items":[]},"albums":{"items":[', "]}}", "'EDITORIAL_LICENSED'", "0.8", url="case when coalesce(width, 0) > 640 then url else url || 's' end"),
    "brave": Landed(_record(f"'url', source_page_url, 'title', title, 'thumbnail', named_struct('src', {HOSTED})"), '{"results":[', "]}", _BY_HOST["license"], _BY_HOST["confidence"], url=HOSTED, author="null"),
    "bing": Landed(_record(f"'contentUrl', url, 'name', title, 'license', if({_EVEN}, {STATED}, null), 'insightsMetadata', if({_EVEN}, null, named_struct('license', {STATED}))"), '{"value":[', "]}", "license", "case when license = 'UNKNOWN' then 0.0 else 0.6 end", author="null"),
    "serpapi": Landed(_record(f"'original', if({_EVEN}, {HOSTED}, null), 'thumbnail', concat({HOSTED}, '?t'), 'title', title, 'source', author"), '{"images_results":[', "]}", _BY_HOST["license"], _BY_HOST["confidence"], url=f"case when {_EVEN} then {HOSTED} else {HOSTED} || '?t' end", most=10),
    "flickr": Landed(
        _record("'id', cast(ordinal as string), 'owner', 'o', 'ownername', author, 'title', title, 'license', case license when 'CC0' then '9' when 'PUBLIC_DOMAIN' then '7' when 'CC_BY' then '4' when 'CC_BY_SA' then '5' when 'UNKNOWN' then '6' else '3' end, 'url_l', url, 'url_z', 'small'"),
        '{"stat":"ok","photos":{"photo":[', "]}}", "license", "0.9", where=_DEEDS,
    ),
    "internet-archive": Landed(_record(f"'identifier', concat('ia', ordinal), 'title', title, 'creator', array(coalesce(author, 'none'), 'Mo'), 'licenseurl', {DEED}"), '{"response":{"docs":[', "]}}", f"case when {_DEEDS} then license else 'UNKNOWN' end", f"case when {_DEEDS} then 0.85 else 0.2 end", url="'https://archive.org/services/img/ia' || ordinal", author="coalesce(author, 'none') || ', Mo'"),
    "smithsonian": Landed(
        _record(f"'title', title, 'content', named_struct('descriptiveNonRepeating', named_struct('online_media', named_struct('media', array(named_struct('type', 'Text', 'content', 'x', 'thumbnail', null), named_struct('type', 'Images', 'content', if({_EVEN}, url, null), 'thumbnail', concat(url, 't'))))), 'freetext', named_struct('name', array(named_struct('content', author))))"),
        '{"response":{"rows":[', "]}}", "'CC0'", "0.95", url=f"case when {_EVEN} then url else url || 't' end",
    ),
    "nasa": Landed(_record("'data', array(named_struct('nasa_id', concat('n', ordinal), 'title', title, 'photographer', author, 'center', 'JPL')), 'links', array(named_struct('href', 'https://n.example/v', 'render', 'video'), named_struct('href', url, 'render', 'image'))"), '{"collection":{"items":[', "]}}", "'PUBLIC_DOMAIN'", "0.95", author="coalesce(author, 'JPL')"),
    "europeana": Landed(_record(f"'guid', source_page_url, 'title', array(title), 'dcCreator', array(author, 'x'), 'edmIsShownBy', array(url), 'edmPreview', array('small'), 'rights', array({DEED})"), '{"items":[', "]}", "license", "0.85", where=_DEEDS),
    "europeana-archival": Landed(_record(f"'title', array(title), 'dcCreator', array(author), 'edmPreview', array(url), 'rights', array({DEED})"), '{"items":[', "]}", "license", "0.8", where=_DEEDS),
    "library-of-congress": Landed(
        _record("'id', source_page_url, 'title', title, 'image_url', array('https://l.example/s', url, concat(url, '&large')), 'rights', case license when 'CC0' then 'CC0' when 'PUBLIC_DOMAIN' then 'No known restrictions' when 'EDITORIAL_LICENSED' then null else 'rights reserved' end, 'contributor', array(author)"),
        '{"results":[', "]}", "case when license = 'CC0' then 'CC0' when license in ('PUBLIC_DOMAIN', 'EDITORIAL_LICENSED') then 'PUBLIC_DOMAIN' else 'UNKNOWN' end", "case when license in ('PUBLIC_DOMAIN', 'EDITORIAL_LICENSED') then 0.85 else 0.2 end", url="url || '&large'",
    ),
    "wellcome-collection": Landed(
        _record("'id', concat('w', ordinal), 'thumbnail', named_struct('url', url, 'license', named_struct('id', case license when 'CC0' then 'cc0' when 'PUBLIC_DOMAIN' then 'pdm' when 'CC_BY' then 'cc-by' when 'CC_BY_SA' then 'CC-BY-SA' else 'cc-by-nc' end)), 'source', named_struct('title', title, 'contributors', array(named_struct('agent', named_struct('label', coalesce(author, ''))), named_struct('agent', named_struct('label', 'Quin'))))"),
        '{"results":[', "]}", "license", "0.9", author="case when coalesce(author, '') = '' then 'Quin' else author || ', Quin' end", where=_DEEDS,
    ),
    "rawpixel": Landed(_record(f"'title', title, 'image_md', url, 'image_1300', if({_EVEN}, concat(url, '3'), null), 'user', named_struct('display_name', author, 'username', 'u')"), '{"results":[', "]}", "'CC0'", "0.9", url=f"case when {_EVEN} then url || '3' else url end", author="coalesce(author, 'u')"),
    "burst": Landed(_record("'title', title, 'image_url', url, 'photographer', named_struct('name', author)"), '{"photos":[', "]}", "'CC0'", "0.95", most=10),
}
_PAGED = f"select *, cast(floor(ordinal / {PAGE}) as bigint) as page from ({CANDIDATES_SQL})"


def responses(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """``query, source, body``: all documents as pages of a source, each of twelve at most."""
    landed = LANDED[source]
    c = candidates(spark, sf_dir).withColumn("page", F.floor(F.col("ordinal") / PAGE).cast("long"))
    items = F.array_sort(F.collect_list(F.struct("ordinal", F.expr(landed.item).alias("item"))))
    body = F.concat(F.lit(landed.before), F.array_join(F.transform(items, lambda i: i["item"]), ","), F.lit(landed.after))
    return c.groupBy("page").agg(body.alias("body")).select(F.col("page").cast("string").alias("query"), F.lit(source).alias("source"), "body")


def expected(source: str) -> str:
    """SQL of what the documents have to become."""
    x = LANDED[source]
    return f"""with c as ({_PAGED}), p as (select *, row_number() over (partition by page order by ordinal) - 1 as place from c)
select page::varchar as query, place::bigint as ordinal, {x.url} as url, {x.license} as license, ({x.confidence})::double as confidence, {x.author} as author, {x.title} as title from p where place < {x.most} and {x.where}"""
