"""Small fixed tables and the schema of the candidate relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# License tags with rank, open, safe in context, needs attribution, name.
LICENSES = [
    ("CC0", 1, True, True, False, "CC0 / Public Domain Dedication"),
    ("PUBLIC_DOMAIN", 2, True, True, False, "Public Domain"),
    ("CC_BY", 3, True, True, True, "CC BY 4.0"),
    ("CC_BY_SA", 4, True, True, True, "CC BY-SA 4.0"),
    ("EDITORIAL_LICENSED", 5, False, True, True, "Editorial Use (platform-licensed)"),
    ("PRESS_KIT_ALLOWLIST", 6, False, True, True, "Official Press Kit"),
    ("UNKNOWN", 99, False, False, False, "Unknown (rejected)"),
]
# Source ids, opt-in, in the default set, display name.
PROVIDERS = [
    ("wikimedia", False, True, "Wikimedia Commons"),
    ("openverse", False, True, "Openverse"),
    ("unsplash", False, True, "Unsplash"),
    ("pexels", False, True, "Pexels"),
    ("pixabay", False, True, "Pixabay"),
    ("itunes", False, True, "iTunes"),
    ("musicbrainz-caa", False, True, "MusicBrainz Cover Art Archive"),
    ("spotify", False, True, "Spotify"),
    ("youtube-thumb", False, False, "YouTube"),
    ("brave", False, True, "Brave Search"),
    ("bing", True, False, "Bing Image Search"),
    ("serpapi", True, False, "Google Images (via SerpAPI)"),
    ("browser", True, False, "Headless Browser (ToS-grey)"),
    ("flickr", False, True, "Flickr (CC)"),
    ("internet-archive", False, True, "Internet Archive"),
    ("smithsonian", False, True, "Smithsonian Open Access"),
    ("nasa", False, True, "NASA"),
    ("met-museum", False, True, "The Met"),
    ("europeana", False, True, "Europeana"),
    ("europeana-archival", True, False, "Europeana Archival"),
    ("library-of-congress", False, True, "Library of Congress"),
    ("wellcome-collection", False, True, "Wellcome Collection"),
    ("rawpixel", False, True, "Rawpixel"),
    ("burst", False, True, "Burst (Shopify)"),
    ("managed-browser", True, False, "managed-browser"),
]
# Plan, monthly cents, included units, window, overage in thousandths
# of a cent a unit, requests a minute, seats, days of audit retention.
PLANS = [
    ("free", 0, 100, "daily", 0, 10, 1, 90),
    ("pro", 1900, 10_000, "monthly", 1500, 100, 1, 180),
    ("team", 7900, 50_000, "monthly", 1000, 300, 5, 365),
    ("enterprise", 0, 1_000_000, "monthly", 0, 1000, 100, 365),
]
# Endpoints that cost units; the free plan has all but the last.
ENDPOINTS = ("/v1/search", "/v1/artist", "/v1/album", "/v1/download", "/v1/probe", "/v1/license", "/v1/similar")
FREE_ENDPOINTS = ENDPOINTS[:-1]
OPEN = [row[0] for row in LICENSES if row[2]]
CONTEXT_SAFE = [row[0] for row in LICENSES if row[3]]

CANDIDATE = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("thumbnail_url", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("mime", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_page_url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("license_url", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)


def license_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        LICENSES, "license string, rank int, is_open boolean, is_context_safe boolean, requires_attribution boolean, pretty string"
    )


def provider_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, "source string, opt_in boolean, is_default boolean, pretty string")


def plan_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PLANS,
        "plan string, base_cents long, included long, quota_window string, overage_millicents long, rate_per_min int, seats int, retention_days int",
    )
