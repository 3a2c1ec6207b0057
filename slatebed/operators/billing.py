"""Usage by customer, seats, plans and the ledger of billing events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def metered_usage(usage: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Each request with what keeps it from being billed: no_workspace, free_tier, no_customer or null."""
    w = workspaces.select("workspace_id", "plan", "customer_id", F.lit(True).alias("_known"))
    why = (
        F.when(F.col("_known").isNull(), "no_workspace")
        .when(~F.coalesce(F.col("plan").isin("pro", "team"), F.lit(False)), "free_tier")
        .when(F.col("customer_id").isNull(), "no_customer")
    )
    return usage.join(w, "workspace_id", "left").withColumn("skipped", why).drop("_known")


def flushed(billed: DataFrame) -> DataFrame:
    """One increment for each customer with units."""
    return billed.where("skipped is null").groupBy("customer_id").agg(F.sum("units").alias("quantity")).where("quantity > 0")


def inferred_plan(price_ids: Column) -> Column:
    ids = F.array_join(price_ids, ",")
    return F.when(ids.contains("team"), "team").when(ids.contains("pro"), "pro").otherwise("free")


def seats(items: Column) -> Column:
    """Of ``array<struct<price_id, quantity>>`` the first seat item's quantity and five, else one."""
    found = F.get(F.filter(items, lambda i: i["price_id"].contains("seat")), F.lit(0))
    return F.when(found.isNotNull(), F.coalesce(found["quantity"], F.lit(0)) + 5).otherwise(1)


def ledger(events: DataFrame) -> DataFrame:
    """``event_id, ts, ok`` deliveries to one row an event: whether it took effect, and at which delivery.

    An event takes effect at its first good delivery; later ones are replays
    and do nothing, earlier ones have failed.
    """
    place = Window.partitionBy("event_id")
    first_good = F.min(F.when(F.col("ok"), F.col("ts"))).over(place)
    rows = events.withColumn("_good", first_good)
    return rows.groupBy("event_id").agg(
        F.first("_good").isNotNull().alias("processed"), F.count_if(~F.col("ok") & (F.col("ts") < F.coalesce("_good", F.col("ts") + F.expr("interval 1 second")))).alias("failures"), F.count("*").alias("deliveries")
    )


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the values of changes, where those have one: what a table of updates holds."""
    c = changes.select(key, *(F.col(x).alias(f"_{x}") for x in columns))
    return rows.join(c, key, "left").select(*(F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in rows.columns))


def without(rows: DataFrame, gone: Column) -> DataFrame:
    """Rows that a delete leaves; a condition that is null deletes nothing."""
    return rows.where(~F.coalesce(gone, F.lit(False)))


def union_seen(seen: DataFrame, new: DataFrame) -> DataFrame:
    """What a query has shown: seen and new, each once, the earliest place first."""
    return seen.unionByName(new).groupBy("query", "url").agg(F.min("ordinal").alias("ordinal"))


def append_usage(batch: DataFrame, path: str) -> int:
    """Appends the requests that the log does not have, for redelivered batches."""
    spark: SparkSession = batch.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = batch.dropDuplicates(["request_id"])
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        new = new.join(spark.read.parquet(path).select("request_id"), "request_id", "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count()
