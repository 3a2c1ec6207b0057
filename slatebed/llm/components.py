"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatebed.llm.common import forget, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, component the smallest node.

    Every round each node points to its smallest neighbour or itself, the
    pointers are followed once more, and the edges are carried over to what
    their ends point at. Local minima are at most half of the nodes, so the
    graph shrinks at least by half each round. Nothing but a row count comes
    to the driver; nodes without an edge are not in the result.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = stored(both.where("a <> b").distinct(), "edges")
    mapping = stored(live.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct(), "labels")
    while not live.isEmpty():
        step = live.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        jump = stored(
            step.alias("s")
            .join(step.alias("t"), F.col("s.to") == F.col("t.node"))
            .select(F.col("s.node").alias("node"), F.col("t.to").alias("to")),
            "jump",
        )
        moved = (
            live.join(jump.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(jump.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .distinct()
        )
        new_live = stored(moved, "edges")
        new_mapping = stored(
            mapping.join(jump.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            ),
            "labels",
        )
        for old in (live, mapping, jump):
            forget(spark, old)
        live, mapping = new_live, new_mapping
    return mapping
