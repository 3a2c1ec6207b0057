from __future__ import annotations

import struct

from pyspark.sql import functions as F

from slatebed.operators import sinks, sites, usage
from slatebed.operators.metadata import embedded_metadata

PAGE = """<meta property="og:image" content="/hero.jpg"><meta name="twitter:image" content="https://x.example/t.png"><link rel="image_src" href="s.gif">
<img src="data:abc"><img src="one.png" alt="One"><img src="/hero.jpg"><a href="big.JPG?x=1">b</a><a href="page.html">p</a>"""


def addresses(spark, html, branches, base="https://site.example/a/"):
    pages = spark.createDataFrame([(1, base, html)], "page_id long, url string, html string")
    return [r.url for r in sites.site_images(pages, branches).orderBy("branch", "ordinal").collect()]


def test_generic_page(spark):
    assert addresses(spark, PAGE, sites.GENERIC) == ["https://site.example/hero.jpg", "https://x.example/t.png", "https://site.example/a/s.gif", "https://site.example/a/one.png", "https://site.example/a/big.JPG?x=1"]


def test_image_results(spark):
    html = """["https://f.example/a.jpg",10,20] <a href="/imgres?imgurl=https%3A%2F%2Ff.example%2Fb.png&amp;imgrefurl=x"> <img src="https://f.example/thumb.jpg">"""
    assert addresses(spark, html, sites.IMAGE_RESULTS) == ["https://f.example/a.jpg", "https://f.example/b.png"]
    assert addresses(spark, '<img src="https://f.example/thumb.jpg">', sites.IMAGE_RESULTS) == ["https://f.example/thumb.jpg"]


def test_pins_and_posts(spark):
    assert addresses(spark, '"https://i.pinimg.com/236x/a/b.jpg" "https://i.pinimg.com/564x/a/b.jpg"', sites.PINS) == ["https://i.pinimg.com/originals/a/b.jpg"]
    assert addresses(spark, '"https://pbs.twimg.com/media/A?format=jpg&amp;name=small"', sites.POSTS) == ["https://pbs.twimg.com/media/A?format=jpg&name=orig"]


def test_dispatch(spark):
    for url, kind in {"https://www.google.com/search": "google-images", "https://www.pinterest.de/x": "pinterest", "https://x.com/a": "twitter", "https://fox.com/": "generic-page", "?": "generic-page"}.items():
        assert spark.range(1).select(sites.extractor_of(F.lit(url)).alias("x")).first().x == kind


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b for m, b in segments) + b"\xff\xd9"


def tiff(artist):
    text = artist.encode() + b"\0"
    return b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHII", 0x013B, 2, len(text), 26) + b"\0\0\0\0" + text


def test_metadata(spark):
    xmp = b'http://ns.adobe.com/xap/1.0/\0<x:xmpmeta><dc:creator><rdf:Seq><rdf:li>Xena</rdf:li></rdf:Seq></dc:creator><cc:license rdf:resource="https://creativecommons.org/licenses/by-sa/4.0/"/></x:xmpmeta>'
    iptc = b"Photoshop 3.0\0" + b"\x1c\x02\x50" + struct.pack(">H", 3) + b"Ivy" + b"\x1c\x02\x74" + struct.pack(">H", 5) + b"(c) I"
    blobs = [("a", jpeg((0xE1, xmp), (0xED, iptc))), ("b", tiff("Eve Artist")), ("c", b"junk"), ("d", None), ("e", jpeg((0xE1, b"Exif\0\0" + tiff("Eve Artist")), (0xED, iptc)))]
    got = {r.id: r for r in embedded_metadata(spark.createDataFrame(blobs, "id string, content binary")).collect()}
    assert (got["a"].artist, got["a"].artist_confidence, got["a"].copyright) == ("Ivy", 0.8, "(c) I")
    assert (got["a"].license, got["a"].license_confidence, got["a"].license_url) == ("CC_BY_SA", 0.95, "https://creativecommons.org/licenses/by-sa/4.0/")
    assert (got["b"].artist, got["b"].artist_confidence) == ("Eve Artist", 0.7)
    assert got["c"].artist is None and got["c"].license == got["d"].license == "UNKNOWN"
    assert (got["e"].artist, got["e"].copyright, got["e"].copyright_confidence) == ("Eve Artist", "(c) I", 0.8)


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private # no\n\nUser-agent: other\nDisallow: /"
    say = lambda path: spark.range(1).select(usage.robots_allow(F.lit(text), F.lit(path), "bot/1.0").alias("x")).first().x
    assert (say("/private/a"), say("/public")) == (False, True)


def test_token_bucket(spark):
    rows = [(i, "k", s) for i, s in enumerate([0, 0, 0, 1, 1, 10])]
    df = spark.createDataFrame(rows, "request_id long, api_key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.request_id: r.allowed for r in usage.token_bucket(df, 2.0, 1.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True}


def test_sinks(spark, tmp_path):
    store = str(tmp_path / "store")
    blobs = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary")
    sinks.put_blobs(blobs, store)
    sinks.put_blobs(blobs.union(spark.createDataFrame([(b"c",)], "content binary")), store)
    assert spark.read.parquet(store).count() == 3
    logs = spark.createDataFrame([("w1", 1, None), ("w1", 9, "x"), ("w2", 2, "y")], "workspace_id string, ts long, note string")
    rest = sinks.archive_and_rest(logs, F.col("ts") < 5, "2024-01-01", str(tmp_path / "archive"))
    assert [r.ts for r in rest.collect()] == [9]
    assert '"note":null' in "".join(p.read_text() for p in (tmp_path / "archive").rglob("part-*"))
    side = spark.range(1).select(sinks.xmp_sidecar(F.lit("A&B"), *[F.lit(None).cast("string")] * 5).alias("x"), sinks.xmp_sidecar(*[F.lit(None).cast("string")] * 5, F.lit("title")).alias("y")).first()
    assert "<dc:creator><rdf:Seq><rdf:li>A&amp;B</rdf:li></rdf:Seq></dc:creator>" in side.x and side.y is None
    ups = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "b")], "k string, t long, v string")
    assert {r.v for r in sinks.latest_by(ups, "k", ["t"]).collect()} == {"new", "b"}


def _letterless(spark, tmp_path):
    rows = [(0, "123 456", "en", "web", 7), (1, None, "fr", "web", 2), (2, "Word", "de", "web", 4), (3, "7" * 9, "en", "web ", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_exif_of_texts_without_letters(spark, tmp_path):
    from slatebed.plans.pages import ext_exif

    got = ext_exif(spark, _letterless(spark, tmp_path)).orderBy("doc_id").collect()
    assert [r.artist for r in got] == ["Word ", "Word ", "Word Word", "Word "]


def test_tiff_with_a_long_text(spark, tmp_path):
    from slatebed.plans.pages import ext_exif

    spark.createDataFrame([(0, "x" * 70_000, "en", "web", 70_000)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert ext_exif(spark, str(tmp_path)).first().artist == "Word " + "x" * 70_000


def test_merged_metadata_of_texts_without_letters(spark, tmp_path):
    from slatebed.plans.pages import ext_iptc, ext_metadata_merge

    folder = _letterless(spark, tmp_path)
    got = ext_metadata_merge(spark, folder).orderBy("doc_id").collect()
    assert [r.artist for r in got] == ["Speaker en", "Word ", "Word Word", "Source web "]
    assert [(r.doc_id, r.artist) for r in ext_iptc(spark, folder).collect()] == [(3, "Source web ")]
