"""Retention: old audit rows into an archive, then out of the log.

The log is a folder of days, so only days that hold old rows are read or
rewritten. A run can break off anywhere and be run again: rows that are in the
archive already are not written twice, and only rows that are in the archive
leave the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatebed.functions.values import retention_days
from slatebed.sources.shared import delete, exists, new_path

#: What tells audit rows apart.
ROW_ID = "request_id"


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("day", F.to_date("ts")).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log; a log without rows has its schema all the same."""
    return spark.read.schema(f"{schema}, day date").parquet(path)


def cutoffs(workspaces: DataFrame, now: Column) -> DataFrame:
    """``workspace_id, cutoff``: the time before which a workspace's rows are old."""
    days = retention_days(F.col("plan"), F.col("audit_retention_days"))
    return workspaces.select("workspace_id", (now - F.make_dt_interval(days)).alias("cutoff"))


def _old(log: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of known workspaces before their cutoff; days after the last cutoff are not read."""
    last = limits.agg(F.max("cutoff")).first()[0]
    if last is None:
        return log.limit(0)
    return log.where(F.col("day") <= F.lit(last).cast("date")).join(limits, "workspace_id").where("ts < cutoff").drop("cutoff")


def archived(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    if not exists(spark, folder):
        return None
    return spark.read.schema(f"{schema}, run_date date").json(folder)


def archive_old(log: DataFrame, limits: DataFrame, folder: str, run_date: str, schema: str) -> None:
    """Old rows that the archive doesn't have, as JSON lines by date and workspace, in order of time; nulls are kept."""
    spark = log.sparkSession
    rows = _old(log, limits).drop("day")
    there = archived(spark, folder, schema)
    if there is not None:
        rows = rows.join(there.select(ROW_ID), ROW_ID, "left_anti")
    out = rows.withColumns({"run_date": F.lit(run_date), "workspace": F.col("workspace_id")})
    out.repartition("workspace").sortWithinPartitions("workspace", "ts", ROW_ID).write.mode("append").partitionBy("run_date", "workspace").option("ignoreNullFields", False).json(folder)


def delete_archived(spark: SparkSession, path: str, limits: DataFrame, folder: str, schema: str) -> None:
    """Takes rows out of the log that are old and in the archive; days left empty go, others are rewritten."""
    there = archived(spark, folder, schema)
    if there is None:
        return
    log = read_log(spark, path, schema)
    gone = _old(log, limits).join(there.select(ROW_ID), ROW_ID, "left_semi").select(ROW_ID, "day")
    staged_ids, staged = new_path(spark, "gone"), new_path(spark, "left")
    gone.write.parquet(staged_ids)
    gone = spark.read.parquet(staged_ids)
    days = [r[0] for r in gone.select("day").distinct().collect()]  # one for each day of the log
    if days:
        left = log.where(F.col("day").isin(days)).join(gone.select(ROW_ID), ROW_ID, "left_anti")
        left.write.parquet(staged)
        left = spark.read.parquet(staged)
        kept = {r[0] for r in left.select("day").distinct().collect()}
        left.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        delete(spark, *(f"{path}/day={d}" for d in days if d not in kept))
    delete(spark, staged_ids, staged)


def retain(spark: SparkSession, path: str, workspaces: DataFrame, now: Column, folder: str, run_date: str, schema: str) -> None:
    """The daily job: archive, then delete."""
    limits = cutoffs(workspaces, now)
    archive_old(read_log(spark, path, schema), limits, folder, run_date, schema)
    delete_archived(spark, path, limits, folder, schema)
