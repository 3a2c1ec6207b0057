"""Tables that take batches of changes by key.

A table is a folder of shards by the key's hash. A batch rewrites the shards
that it has keys of and no others: their old rows are merged with the batch
into a staging table first, then the staged shards replace theirs. A batch that
was broken off can be given again, as merges say by order which value is newer
and a batch's mark keeps it from being counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatebed.sources.shared import delete, exists, new_path


class ShardedTable:
    """Rows by unique ``key`` under ``path``; ``merge`` makes one row of several of a key.

    ``merge`` maps columns to aggregates over the old row and the batch's rows,
    which come with the same columns.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, merge: dict[str, Column], shards: int = 64):
        self.spark, self.path, self.key, self.merge, self.shards = spark, path, key, merge, shards

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("shard")

    def upsert(self, batch: DataFrame) -> list[int]:
        """Merges a batch; gives the shards it has rewritten, as many as the table has at most."""
        of_shard = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.shards)).cast("int")
        new = batch.withColumn("shard", of_shard)
        touched = sorted(r[0] for r in new.select("shard").distinct().collect())  # numbers below shards
        rows = new
        if exists(self.spark, self.path):
            old = self.spark.read.parquet(self.path).where(F.col("shard").isin(touched))  # reads their folders only
            rows = old.unionByName(new, allowMissingColumns=True)
        merged = rows.groupBy("shard", self.key).agg(*(c.alias(name) for name, c in self.merge.items()))
        staged = new_path(self.spark, "staged")
        merged.write.partitionBy("shard").parquet(staged)
        if touched:
            whole = self.spark.read.parquet(staged).repartition("shard")
            whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.path)
        delete(self.spark, staged)
        return touched


def cache_index(spark: SparkSession, path: str, shards: int = 64) -> ShardedTable:
    """Blobs by hash: first sight with its type, size and address, last hit and number of hits.

    ``hits`` holds the hits of each batch under its name, so a batch that comes
    again replaces its own.
    """
    first = lambda c: F.min_by(c, "first_seen")
    merge = {
        "mime": first("mime"), "bytes": first("bytes"), "source_url": first("source_url"), "first_seen": F.min("first_seen"), "last_hit": F.max("last_hit"),
        "hits": F.map_from_entries(F.array_distinct(F.flatten(F.collect_list(F.map_entries("hits"))))),
    }
    return ShardedTable(spark, path, "sha256", merge, shards)


def hits(downloads: DataFrame, batch: str) -> DataFrame:
    """``sha256, mime, bytes, source_url, ts`` of downloads as a batch for :func:`cache_index`."""
    first = lambda c: F.min_by(c, F.struct("ts", "source_url")).alias(c)
    found = downloads.groupBy("sha256").agg(first("mime"), first("bytes"), first("source_url"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_hit"), F.count("*").alias("_n"))
    return found.withColumn("hits", F.create_map(F.lit(batch), F.col("_n"))).drop("_n")


def hit_count() -> Column:
    return F.aggregate(F.map_values("hits"), F.lit(0).cast("long"), lambda a, b: a + b)


#: What a subscription's row and its workspace's row take over from the newest event.
SUBSCRIPTION = ("customer_id", "plan", "status", "seats")
MIRRORED = ("plan", "status")


def subscriptions(spark: SparkSession, path: str, shards: int = 64) -> ShardedTable:
    """One row a workspace: what its newest event says."""
    newest = F.struct("updated_at", "event_id")
    merge = {c: F.max_by(c, newest) for c in SUBSCRIPTION}
    return ShardedTable(spark, path, "workspace_id", merge | {"event_id": F.max_by("event_id", newest), "updated_at": F.max("updated_at")}, shards)


def workspaces(spark: SparkSession, path: str, shards: int = 64) -> ShardedTable:
    """Workspaces whose mirrored columns follow the newest event, where there has been one; the rest is as it was made."""
    newest = F.struct("updated_at", "event_id")
    merge = {c: F.max_by(c, newest) for c in MIRRORED} | {"customer_id": F.max("customer_id"), "event_id": F.max_by("event_id", newest), "updated_at": F.max("updated_at")}
    return ShardedTable(spark, path, "workspace_id", merge, shards)


def apply_events(events: DataFrame, subs: ShardedTable, spaces: ShardedTable) -> None:
    """Subscription events into both tables; given again after a crash between them, both end the same.

    Workspaces that don't exist get a subscription, as the events say, and no
    row of their own.
    """
    newest = events.groupBy("workspace_id").agg(F.max_by(F.struct(*SUBSCRIPTION, "event_id", "updated_at"), F.struct("updated_at", "event_id")).alias("e")).select("workspace_id", "e.*")
    subs.upsert(newest)
    known = newest.join(spaces.read().select("workspace_id"), "workspace_id", "left_semi")
    spaces.upsert(known.select("workspace_id", *MIRRORED, F.lit(None).cast("string").alias("customer_id"), "event_id", "updated_at"))
