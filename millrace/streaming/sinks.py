"""Micro-batch sinks: one write per outcome, repeatable by batch id."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators.settle import ACK, DEAD, INVALID, RETRY, RetryPolicy, settle

OUTCOMES = (ACK, INVALID, DEAD, RETRY)


def settle_stream(stream: DataFrame, handler: Callable[[DataFrame], DataFrame], error: Callable[[], Column], attempt: Callable[[], Column], policy: RetryPolicy, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run the handler on every micro-batch and write each outcome to its own folder.

    A batch that is repeated after a failure overwrites what it wrote before, so a message is diverted once;
    the batch counts as settled only when all outcomes are written. Acknowledging is the checkpoint's commit.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        done = settle(handler(batch), error(), attempt(), policy).persist()
        try:
            for outcome in OUTCOMES:
                done.where(done.outcome == outcome).write.mode("overwrite").parquet(f"{out}/{outcome}/batch_id={batch_id}")
        finally:
            done.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def dedup_stream(stream: DataFrame, message_id: str, at: str, retention: str) -> DataFrame:
    """The first message of each id; ids are forgotten after the retention."""
    return stream.withWatermark(at, retention).dropDuplicatesWithinWatermark([message_id])


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that a stream has to offer now."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def stop_gracefully(query: StreamingQuery, within_s: float = 30.0, poll_s: float = 0.05) -> bool:
    """Stop a query between two batches, so that what it has begun is settled; after ``within_s`` seconds it is
    stopped anyway. True if it came to a rest in time."""
    until = time.monotonic() + within_s
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(poll_s)
    rested = not (query.isActive and query.status["isTriggerActive"])
    query.stop()
    return rested


def outbox(stream: DataFrame, handler: Callable[[DataFrame], tuple[DataFrame, DataFrame]], business: str, messages: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a handler's rows and the messages it sends in one micro-batch; a repeated batch overwrites both."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows, sent = handler(batch)
        rows.write.mode("overwrite").parquet(f"{business}/batch_id={batch_id}")
        sent.write.mode("overwrite").parquet(f"{messages}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
