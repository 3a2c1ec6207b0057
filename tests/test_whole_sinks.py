"""File names of a manifest beyond three digits."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatebed.operators import sinks


def test_manifest_numbers_keep_all_digits(spark):
    ranked = spark.range(1, 1202).select(
        F.lit("q").alias("query"), F.lit("https://a.example/x.jpg").alias("url"), F.lit("CC0").alias("license"), F.col("id").cast("int").alias("position")
    )
    files = {r.position: r.file for r in sinks.manifest(ranked).collect()}
    assert len(set(files.values())) == 1201 and files[7] == "007.jpg" and files[1000] == "1000.jpg"
