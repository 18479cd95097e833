"""An in-process broker: a list of messages that batch plans read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "message_id string, correlation_id string, payload string"


class FullError(RuntimeError):
    """A broker without room."""


class Broker:
    """Messages in the order in which they were sent. Settled ones are gone; a rejected one that is to be
    delivered again goes to the tail at once, whatever the delay. It holds at most ``capacity`` messages."""

    def __init__(self, schema: str = SCHEMA, capacity: int = 1 << 16) -> None:
        self.schema, self.capacity, self._queue, self._out = schema, capacity, [], {}

    def send(self, rows: list[tuple] | DataFrame) -> None:
        """Append messages; those of a frame come to the driver, as the broker lives there, in one batch of
        Arrow and must not be more than the broker has room for."""
        if isinstance(rows, DataFrame):
            names = rows.columns
            rows = rows.limit(self.capacity - len(self._queue) + 1).toArrow().to_pylist()
            rows = [tuple(r[c] for c in names) for r in rows]
        if len(self._queue) + len(rows) > self.capacity:
            raise FullError(f"more than {self.capacity} messages")
        self._queue.extend(tuple(r) for r in rows)

    def poll(self, spark: SparkSession, most: int = 100) -> DataFrame:
        """The next messages, in flight until they are settled."""
        taken, self._queue = self._queue[:most], self._queue[most:]
        self._out |= {r[0]: r for r in taken}
        return spark.createDataFrame(taken, self.schema)

    def ack(self, message_id: str) -> None:
        self._out.pop(message_id, None)

    def nack(self, message_id: str, requeue: bool = True) -> None:
        row = self._out.pop(message_id, None)
        if requeue and row is not None:
            self._queue.append(row)

    def __len__(self) -> int:
        return len(self._queue)
