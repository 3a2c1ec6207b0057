"""Running totals and places in groups of any size.

A window over a group is one task and one sort for all of its rows. Here the
rows are dealt by ranges of group and order, so that a large group lies in many
parts; each part totals its own rows, and what the parts before have of the
same group is added. Only a part's first group can have begun before it, so the
additions are at most one row a part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatebed.sources.shared import written


def running_total(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Rows with the sum of ``value`` (whole numbers) over the rows of their group up to and with them.

    ``order`` has to tell any two rows of a group apart. Null group keys are a
    group, null values add nothing.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    # written, as a range is told from a sample and a row must not change its part
    placed = written(df.withColumn("_value", F.coalesce(value, F.lit(0)).cast("long")).repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "totals")
    sums = placed.groupBy("_part", *group).agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    added = sums.select("_part", *group, before.alias("_before")).where("_before is not null")
    inside = F.sum("_value").over(Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    here = placed.withColumn("_inside", inside).alias("h")
    same = reduce(lambda a, b: a & b, [F.col(f"h.{g}").eqNullSafe(F.col(f"a.{g}")) for g in ("_part", *group)])
    total = (F.col("h._inside") + F.coalesce("a._before", F.lit(0))).alias(name)
    # one row for a part at most, and the session bounds the parts
    return here.join(F.broadcast(added).alias("a"), same, "left").select(*(F.col(f"h.`{c}`") for c in df.columns if c != name), total)


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Rows with their place, from 1, in the total order of their group."""
    return running_total(df, group, order, F.lit(1), name)
