"""A consumer of usage messages with an outcome for each, retries and dead letters.

Every micro-batch is a generation of three tables: what was stored, what is to
be tried again and what was given up. It reads its messages and the retries of
the generation before, which no longer change, and overwrites its own folders,
so a batch that is delivered again after a crash ends the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatebed.sources.shared import delete, exists

#: What a message is tried again for at most, and messages and seconds of a batch.
MOST_RETRIES, BATCH_MESSAGES, BATCH_SECONDS = 3, 100, 10


class UsageQueue:
    """``store`` gets messages with ``attempts`` and returns them with a boolean ``stored``; null counts as failed.

    It has to answer the same for the same message and attempt.
    """

    def __init__(self, spark: SparkSession, folder: str, store: Callable[[DataFrame], DataFrame], most_retries: int = MOST_RETRIES):
        self.spark, self.folder, self.store, self.most_retries = spark, folder, store, most_retries
        self.last = -1

    def _of(self, table: str, number: int) -> str:
        return f"{self.folder}/{table}/batch={number}"

    def consume(self, messages: DataFrame | None, number: int) -> None:
        """One generation: the batch's messages and the retries before it, each with its outcome."""
        parts = [] if messages is None else [messages.withColumn("attempts", F.lit(0))]
        if number and exists(self.spark, self._of("retry", number - 1)):
            parts.append(self.spark.read.parquet(self._of("retry", number - 1)))
        if not parts:
            return
        waiting = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        tried = self._of("tried", number)
        # written, so that the three tables are of one outcome
        self.store(waiting.withColumn("attempts", F.col("attempts") + 1)).write.mode("overwrite").parquet(tried)
        done = self.spark.read.parquet(tried)
        stored = F.coalesce("stored", F.lit(False))
        again = ~stored & (F.col("attempts") <= self.most_retries)
        for table, rows in (("log", stored), ("retry", again), ("dead", ~stored & ~again)):
            done.where(rows).drop("stored").write.mode("overwrite").parquet(self._of(table, number))
        delete(self.spark, tried, *([self._of("retry", number - 2)] if number > 1 else []))
        self.last = max(self.last, number)

    def drain(self) -> None:
        """Generations without new messages until nothing waits; a message waits for as many as it has retries."""
        while self.last >= 0 and not self.spark.read.parquet(self._of("retry", self.last)).isEmpty():
            self.consume(None, self.last + 1)

    def table(self, name: str) -> DataFrame:
        """``log`` or ``dead`` over all generations."""
        return self.spark.read.parquet(f"{self.folder}/{name}").drop("batch")

    def run(self, stream: DataFrame, checkpoint: str, live: bool = False) -> None:
        """Consumes a stream to its end and drains, or goes on with a batch every few seconds."""
        writer = stream.writeStream.foreachBatch(self.consume).option("checkpointLocation", checkpoint)
        if live:
            writer.trigger(processingTime=f"{BATCH_SECONDS} seconds").start()
            return
        writer.trigger(availableNow=True).start().awaitTermination()
        self.drain()
