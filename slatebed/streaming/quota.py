"""The quota gate over a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slatebed.operators.quota import planned

DECISION = "request_id long, workspace_id string, allow boolean, reason string, used long, overage long"
#: How long a window's total outlives the window.
BUFFER_MS = 3_600_000


class QuotaGate(StatefulProcessor):
    """Holds what each window of a workspace has used; a timer at its end lets it go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "start long", "used long, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the order of time within a micro-batch; batches come one after another
        batch = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")
        totals: dict[int, int] = {}
        ends: dict[int, int] = {}
        columns = [batch[c].tolist() for c in ("request_id", "start_ms", "end_ms", "plan", "included", "units", "forbidden")]
        allows, reasons, before, over = [], [], [], []
        for _, start, end, plan, included, units, forbidden in zip(*columns):
            if start not in totals:
                totals[start] = int(self.used.getValue((start,))[0]) if self.used.containsKey((start,)) else 0
                ends[start] = end + BUFFER_MS
                self.handle.registerTimer(ends[start])
            used = totals[start]
            fits = plan != "free" or used + units <= included
            allow = fits and not forbidden
            allows.append(allow)
            reasons.append("plan_endpoint_forbidden" if forbidden else None if fits else "quota_exceeded_free")
            before.append(0 if forbidden else used)
            over.append(max(0, used + units - included) if allow else 0)
            if allow:
                totals[start] = used + units
        for start, used in totals.items():
            self.used.updateValue((start,), (used, ends[start]))
        yield pd.DataFrame({"request_id": columns[0], "workspace_id": key[0], "allow": allows, "reason": reasons, "used": before, "overage": over})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for start in [k[0] for k, v in self.used.iterator() if v[1] <= now]:
            self.used.removeKey((start,))
        yield from ()

    def close(self) -> None:
        pass


def quota_gate(stream: DataFrame, workspaces: DataFrame, late: str = "1 hour") -> DataFrame:
    """Decisions as :func:`slatebed.operators.quota.quota_decisions` has them, for requests that come in order of time."""
    rows = planned(stream.withColumn("ts", F.col("ts").cast("timestamp")), workspaces)
    start = F.col("window_start").cast("timestamp")
    end = F.when(F.col("plan") == "free", start + F.expr("interval 1 day")).otherwise(F.add_months(F.col("window_start"), 1).cast("timestamp"))
    timed = rows.withColumns({"start_ms": F.unix_millis(start), "end_ms": F.unix_millis(end)}).drop("window_start").withWatermark("ts", late)
    return timed.groupBy("workspace_id").transformWithStateInPandas(statefulProcessor=QuotaGate(), outputStructType=DECISION, outputMode="Append", timeMode="EventTime")
