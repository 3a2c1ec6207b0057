"""Writers: content store, archives, sidecars and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatebed.functions.values import xml_escape


def put_blobs(blobs: DataFrame, store: str) -> None:
    """Appends ``content`` under its SHA-256, sharded by two digits; hashes already there are left alone."""
    spark: SparkSession = blobs.sparkSession
    new = blobs.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"]).withColumn("shard", F.substring("sha256", 1, 2))
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        new = new.join(spark.read.parquet(store).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").partitionBy("shard").parquet(store)


def archive_and_rest(rows: DataFrame, old: Column, run_date: str, folder: str) -> DataFrame:
    """Writes the rows that are old as JSON lines by date and workspace, nulls kept, and returns the others."""
    rows.where(old).withColumn("run_date", F.lit(run_date)).write.mode("append").partitionBy("run_date", "workspace_id").option("ignoreNullFields", False).json(folder)
    return rows.where(~F.coalesce(old, F.lit(False)))


def xmp_sidecar(creator: Column, rights: Column, license_url: Column, license_tag: Column, page: Column, title: Column, tool: str = "sidecar") -> Column:
    """An XMP packet with what is known of a picture's credit; null if there is neither maker, line, license nor page."""
    some = lambda c: F.nullif(c, F.lit(""))
    line = lambda text, body: F.coalesce(F.concat(F.lit("    "), body(xml_escape(some(text))), F.lit("\n")), F.lit(""))
    plain = lambda tag: lambda v: F.concat(F.lit(f"<{tag}>"), v, F.lit(f"</{tag}>"))

    def listed(tag: str, kind: str, attributes: str = "") -> object:
        return lambda v: F.concat(F.lit(f"<{tag}><rdf:{kind}><rdf:li{attributes}>"), v, F.lit(f"</rdf:li></rdf:{kind}></{tag}>"))

    spoken = lambda tag: listed(tag, "Alt", ' xml:lang="x-default"')
    stated = F.coalesce(page, license_url)
    body = F.concat(
        line(creator, listed("dc:creator", "Seq")), line(rights, spoken("dc:rights")), line(title, spoken("dc:title")), line(page, listed("dc:source", "Bag")),
        line(F.coalesce(license_url, license_tag), plain("cc:license")), line(rights, spoken("xmpRights:UsageTerms")), line(stated, plain("xmpRights:WebStatement")),
    )
    head = (
        f'<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="{tool}">\n  <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'
        '    <rdf:Description rdf:about=""\n        xmlns:dc="http://purl.org/dc/elements/1.1/"\n        xmlns:cc="http://creativecommons.org/ns#"\n        xmlns:xmpRights="http://ns.adobe.com/xap/1.0/rights/">\n'
    )
    foot = '    </rdf:Description>\n  </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>\n'
    known = F.coalesce(some(creator), some(rights), some(license_tag), some(stated)).isNotNull()
    return F.when(known, F.concat(F.lit(head), body, F.lit(foot)))


def markdown_image(title: Column, path: Column, line: Column) -> Column:
    return F.concat(F.lit("!["), F.coalesce(title, F.lit("image")), F.lit("]("), path, F.lit(")"), F.coalesce(F.concat(F.lit("\n*"), line, F.lit("*")), F.lit("")))


def manifest(ranked: DataFrame) -> DataFrame:
    """File names for the rows of a ranking, numbered by position within the query."""
    ending = F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"\.([A-Za-z]{3,4})(?:[?#]|$)", 1), F.lit("")), F.lit("img")))
    return ranked.withColumn("file", F.concat(F.format_string("%03d", F.col("position")), F.lit("."), ending)).select("query", "file", "url", "license", "position")


def latest_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: what a table of upserts holds."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_p", place).where("_p = 1").drop("_p")


def get_blobs(spark: SparkSession, store: str, wanted: DataFrame) -> DataFrame:
    """``sha256, content`` of the wanted hashes that the store has; only their shards are read."""
    keys = wanted.select("sha256", F.substring("sha256", 1, 2).alias("shard"))
    return spark.read.option("basePath", store).schema("content binary, sha256 string, shard string").parquet(store).join(keys, ["shard", "sha256"])


def provenance(url: Column, page: Column, extractor: Column, license_tag: Column, confidence: Column) -> Column:
    """JSON that says where an image is from and by what it was found."""
    return F.to_json(
        F.struct(
            url.alias("imageUrl"), page.alias("sourcePageUrl"), extractor.alias("extractor"), F.concat(F.lit("browser:"), extractor).alias("fetchedVia"), license_tag.alias("license"), F.coalesce(confidence, F.lit(0.0)).alias("licenseConfidence")
        )
    )
