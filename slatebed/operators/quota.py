"""Admission by plan: endpoints, the free plan's cap and the overage of paid ones.

Within a window requests are decided in order of time and id. A refused request
takes nothing, one that is let through takes its units whether or not it then
fails. A paid plan refuses no request for its units, so what was used before is
a running total. The free plan refuses what doesn't fit into what is left; with
units of many sizes that is a rule about one request after another, and still
takes few rounds over all of them: the requests that fit on from the start are
a prefix by running total, and after the first one that doesn't, only smaller
ones can fit. So each round is left with smaller requests than the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatebed.dims import ENDPOINTS, FREE_ENDPOINTS, PLANS
from slatebed.operators.totals import running_total
from slatebed.operators.usage import known_plan, plan_window
from slatebed.sources.shared import written

GROUP, ORDER = ["workspace_id", "window_start"], ["ts", "request_id"]


def included(plan: Column) -> Column:
    out = F.lit(PLANS[0][2])
    for row in PLANS[1:]:
        out = F.when(plan == row[0], row[2]).otherwise(out)
    return out.cast("long")


def planned(requests: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``request_id, workspace_id, ts, units, plan, window_start, included, forbidden`` of each request.

    A workspace that isn't known is on the free plan; units that are null count as none.
    """
    plans = workspaces.select("workspace_id", known_plan(F.col("plan")).alias("plan"))
    rows = requests.select("request_id", "workspace_id", "ts", "endpoint", F.coalesce("units", F.lit(0)).cast("long").alias("units"))
    rows = rows.join(plans, "workspace_id", "left").withColumn("plan", F.coalesce("plan", F.lit("free")))
    allowed = F.when(F.col("plan") == "free", F.col("endpoint").isin(*FREE_ENDPOINTS)).otherwise(F.col("endpoint").isin(*ENDPOINTS))
    return rows.select(
        "request_id", "workspace_id", "ts", "units", "plan", plan_window(F.col("plan"), F.col("ts"))[0].alias("window_start"), included(F.col("plan")).alias("included"), (~F.coalesce(allowed, F.lit(False))).alias("forbidden")
    )


def decision(used: Column) -> list[Column]:
    """``allow, reason, used, overage`` from what was used before a request."""
    fits = (F.col("plan") != "free") | (used + F.col("units") <= F.col("included"))
    allow = ~F.col("forbidden") & fits
    reason = F.when(F.col("forbidden"), "plan_endpoint_forbidden").when(~fits, "quota_exceeded_free")
    over = F.when(allow, F.greatest(used + F.col("units") - F.col("included"), F.lit(0))).otherwise(0)
    return [allow.alias("allow"), reason.alias("reason"), F.when(F.col("forbidden"), 0).otherwise(used).cast("long").alias("used"), over.cast("long").alias("overage")]


def free_admissions(rows: DataFrame) -> DataFrame:
    """``request_id`` of the requests that fit into ``included``, each taking its units; see the module."""
    order = [F.col(c) for c in ORDER]
    totals = rows.groupBy(*GROUP).agg(F.sum("units").alias("_all"), F.first("included").alias("_most"))
    crowded = totals.where("_all > _most").select(*GROUP)
    fitting = rows.join(crowded, GROUP, "left_anti").select("request_id")
    left = written(rows.join(crowded, GROUP, "left_semi").where("units <= included").select(*GROUP, *ORDER, "units", F.col("included").alias("room")), "quota")
    while not left.isEmpty():
        summed = written(running_total(left, GROUP, order, F.col("units"), "_sum"), "quota")
        inside = summed.where("_sum <= room")
        fitting = fitting.union(inside.select("request_id"))
        spent = inside.groupBy(*GROUP).agg(F.sum("units").alias("_spent"))
        rest = summed.where("_sum > room").join(spent, GROUP, "left").withColumn("room", F.col("room") - F.coalesce("_spent", F.lit(0)))
        left = written(rest.where("units <= room").select(left.columns), "quota")
    return fitting


def quota_decisions(requests: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``request_id, workspace_id, allow, reason, used, overage`` of each request.

    ``used`` is what the window held before it, 0 for an endpoint that the plan
    doesn't have.
    """
    rows = written(planned(requests, workspaces), "requests")
    open_free = rows.where("plan = 'free' and not forbidden")
    takes = written(free_admissions(open_free).withColumn("_in", F.lit(True)), "admitted")
    known = rows.join(takes, "request_id", "left")
    taken = F.when(F.col("forbidden"), 0).when((F.col("plan") != "free") | F.coalesce("_in", F.lit(False)), F.col("units")).otherwise(0)
    done = running_total(known.withColumn("_taken", taken), GROUP, [F.col(c) for c in ORDER], F.col("_taken"), "_sum")
    return done.select("request_id", "workspace_id", *decision(F.col("_sum") - F.col("_taken")))
