"""State by key that lives with the stream: the latest build of every path wins, and what was deleted is forgotten in time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: With timers of processing time Spark would go on with empty batches for ever, and a run to the end of what is there would never end.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


class LatestWins(StatefulProcessor):
    """Keeps of every key the row with the greatest order (order, then tie), whatever batch it comes in, and gives it on when it is new.

    A row of kind delete stays as a mark, so that an older row that comes late doesn't bring the key back; its timer clears it after
    `forget` milliseconds.
    """

    def __init__(self, forget: int):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long, tie long, kind string, body string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.latest.get()  # None if there is none
        before = best = None if held is None else tuple(held)
        for row in rows:
            if best is None or (row["at"], row["tie"]) > best[:2]:
                best = (row["at"], row["tie"], row["kind"], row["body"])
        if best == before:
            return
        self.latest.update(best)
        if best[2] == "delete":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget)
        yield Row(key=key[0], at=best[0], tie=best[1], kind=best[2], body=best[3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A deleted key goes, unless something newer came or a later deletion waits for its own timer."""
        if self.latest.exists() and self.latest.get()[2] == "delete" and not any(True for _ in self.handle.listTimers()):
            self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession):
    """Such state needs the RocksDB store; the session's own choices come back."""
    chosen = {PROVIDER: ROCKS, EMPTY_BATCHES: "false"}
    before = {k: spark.conf.get(k) for k in chosen}
    for k, v in chosen.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def latest(changes: DataFrame, forget: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """A stream of key, at, tie, kind, body to a stream of the rows that were the latest of their key when they came."""
    return changes.groupBy("key").transformWithState(LatestWins(forget), "key string, at long, tie long, kind string, body string", "Update", "ProcessingTime")


def run_latest(changes: DataFrame, progress: str, forget: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """key, at, tie, kind, body: the state after all that the stream holds now; a run with the same progress folder goes on where the last one stopped.

    Timers that are over fire with the next batch that has rows.
    """
    spark = changes.sparkSession
    with _rocks(spark):
        query = latest(changes, forget).writeStream.format("noop").outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).start()
        query.awaitTermination()
        return state(spark, progress)


def state(spark: SparkSession, progress: str) -> DataFrame:
    """The state table as the last batch left it, read from the store."""
    return spark.read.format("statestore").option("stateVarName", "latest").load(progress).selectExpr("key.key AS key", "value.at AS at", "value.tie AS tie", "value.kind AS kind", "value.body AS body")
