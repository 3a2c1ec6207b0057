"""Lists of queries as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_entries(lines: DataFrame) -> DataFrame:
    """``query, providers`` in place of ``value``: a query and, after a tab, sources between commas.

    Blank lines and those that start with # go; without sources there is null.
    """
    line = F.trim(F.col("value"))
    named = F.filter(F.transform(F.split(F.get(F.split("value", "\t", 2), F.lit(1)), ","), lambda s: F.trim(s)), lambda s: s != "")
    kept = lines.where((line != "") & ~line.startswith("#"))
    providers = F.when(F.size(named) > 0, named)
    return kept.select(*(c for c in lines.columns if c != "value"), F.trim(F.get(F.split("value", "\t", 2), F.lit(0))).alias("query"), providers.alias("providers"))
