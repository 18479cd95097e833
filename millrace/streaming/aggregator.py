"""The aggregator as a streaming operator: groups in keyed state, released by rules, expired by timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "group_key string, batch long, n_members long, total double, first_id string, fate string"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with timers needs, while a query is started."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


META = "batch long, timer long, n long, total double, first_id string, size long"


class GroupProcessor(StatefulProcessor):
    """Holds a live group: how many members, their total, the first one, and the ids, to which a batch only
    appends unless it releases the group; ``completion_size`` 0 means the first member's sequence size.

    A repeated id changes nothing while its group lives and is forgotten with it. An incomplete group goes
    to ``expired`` when the timeout after its first member has passed. Members are kept in arrival order.
    """

    def __init__(self, completion_size: int = 0, timeout_ms: int = 0) -> None:
        self.completion_size, self.timeout_ms = completion_size, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getListState("ids", "message_id string")
        self.meta = handle.getValueState("meta", META)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, timer, n, total, first, size = self.meta.get() if self.meta.exists() else (0, 0, 0, 0.0, None, 0)
        live = {i for (i,) in self.ids.get()} if n else set()
        done, fresh, released = [], [], False
        for pdf in rows:
            for m in pdf.sort_values(["place", "message_id"]).itertuples(index=False):
                if m.message_id in live:
                    continue
                if not n:
                    first, size, total = m.message_id, 0 if pd.isna(m.size_) else int(m.size_), 0.0
                live.add(m.message_id)
                fresh.append((m.message_id,))
                n, total = n + 1, total + float(m.value)
                if self.timeout_ms and not timer:
                    timer = int(timerValues.getCurrentProcessingTimeInMs()) + self.timeout_ms
                    self.handle.registerTimer(timer)
                enough = self.completion_size or size
                if enough and n >= enough:
                    done.append((key[0], batch, n, total, first, "output"))
                    live, fresh, released, batch, n = set(), [], True, batch + 1, 0
                    if timer:
                        self.handle.deleteTimer(timer)
                        timer = 0
        if released:
            self.ids.put(fresh) if fresh else self.ids.clear()
        elif fresh:
            self.ids.appendList(fresh)
        self.meta.update((batch, timer, n, total, first, size))
        yield pd.DataFrame(done, columns=["group_key", "batch", "n_members", "total", "first_id", "fate"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, _, n, total, first, _ = self.meta.get() if self.meta.exists() else (0, 0, 0, 0.0, None, 0)
        self.ids.clear()
        self.meta.update((batch + 1, 0, 0, 0.0, None, 0))
        rows = [(key[0], batch, n, total, first, "expired")] if n else []
        yield pd.DataFrame(rows, columns=["group_key", "batch", "n_members", "total", "first_id", "fate"])

    def close(self) -> None:
        pass


def aggregate_stream(stream: DataFrame, completion_size: int = 0, timeout_ms: int = 0) -> DataFrame:
    """Groups of a stream ``(group_key, message_id, place, size_, value)`` as they are released or expire."""
    return stream.groupBy("group_key").transformWithStateInPandas(
        statefulProcessor=GroupProcessor(completion_size, timeout_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if timeout_ms else "None"
    )
