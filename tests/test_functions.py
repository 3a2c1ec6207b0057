from __future__ import annotations

from pyspark.sql import functions as F

from slatebed.functions import license as lic
from slatebed.functions import urls, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_coerce_license(spark):
    cases = {"CC BY-SA 4.0": "CC_BY_SA", "cc-by-sa-3.0": "CC_BY_SA", "CC0": "CC0", "Official press photo": "PRESS_KIT_ALLOWLIST", "all rights reserved": "UNKNOWN", "": "UNKNOWN", "Photo by Ann": "CC_BY", "ruby": "UNKNOWN"}
    for text, tag in cases.items():
        assert one(spark, lic.coerce_license(F.lit(text))) == tag
    assert one(spark, lic.coerce_license(F.lit(None).cast("string"))) == "UNKNOWN"
    assert one(spark, lic.coerce_license(F.lit("CC BY-NC 4.0"), strict=True)) == "UNKNOWN"


def test_attribution(spark):
    none = F.lit(None).cast("string")
    assert one(spark, lic.attribution(F.lit("CC_BY"), F.lit("Ann"), F.lit("Flickr (CC)"), F.lit("https://p"), F.lit("Cat"))) == '"Cat" by Ann (Flickr (CC)), licensed CC BY 4.0 — https://p'
    assert one(spark, lic.attribution(F.lit("CC0"), F.lit(""), none, none, none)) == "Photo, licensed CC0 / Public Domain Dedication"


def test_public_url(spark):
    for url, ok in {"https://example.org/a": True, "http://127.0.0.1/": False, "http://192.168.1.1/": False, "http://[::1]/": False, "file:///etc": False, "https://100.64.0.1/": False, "x": False}.items():
        assert one(spark, urls.is_public_url(F.lit(url))) is ok


def test_costs(spark):
    cost = one(spark, values.project_cost(F.lit("pro"), F.lit(11_000), F.lit(1900), F.lit(10_000), F.lit(1500)))
    assert (cost.overage_units, cost.overage_cents, cost.total_cents) == (1000, 1500, 3400)


def test_intervals(spark):
    for text, ms in {"30s": 30_000, "15m": 900_000, "2h": 7_200_000, "1d": 86_400_000, "1w": None, "": None}.items():
        assert one(spark, values.parse_interval(F.lit(text))) == ms


def test_hamming(spark):
    assert one(spark, values.hamming(F.lit("f" * 16), F.lit("0" * 16))) == 64
    assert one(spark, values.hamming(F.lit("ff"), F.lit("f"))) == 4
    assert one(spark, values.hamming(F.lit(""), F.lit("ab"))) == 8


def test_hash_of_pixels(spark):
    ramp = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: i.cast("double"))
    got = one(spark, values.dct_hash(ramp))
    assert len(got) == 16 and got == one(spark, values.dct_hash(ramp))
    assert one(spark, values.dct_hash(F.array(F.lit(1.0)))) is None
    assert one(spark, values.average_hash(F.lit("").cast("binary"))) == "0" * 16


def test_csv_and_markup(spark):
    assert one(spark, values.csv_cell(F.lit('a"b,c'))) == '"a""b,c"'
    assert one(spark, values.csv_cell(F.lit(None).cast("string"))) == ""
    assert one(spark, values.xml_escape(F.lit("<a&'\">"))) == "&lt;a&amp;&apos;&quot;&gt;"
    assert one(spark, values.slug(F.lit("Hello, World!"))) == "hello-world"


def test_minute_bucket_rounds_to_milliseconds_first(spark, tmp_path):
    from slatebed.plans.more import fn_minute_bucket

    times = ["2024-01-01 00:00:59.999499", "2024-01-01 00:00:59.9995", "1969-12-31 23:58:59.9995", "1969-12-31 23:58:59.999501", "1969-12-31 23:59:59.9999", None]
    spark.createDataFrame(list(enumerate(times)), "event_id long, at string").selectExpr("event_id", "cast(at as timestamp_ntz) as ts").write.parquet(f"{tmp_path}/events.parquet")
    got = [r.minute for r in fn_minute_bucket(spark, str(tmp_path)).orderBy("event_id").collect()]
    assert got == [28401120, 28401121, -2, -1, 0, None]
