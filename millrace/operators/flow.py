"""Flow composition: filter, transform, route, split, activate, channels and publish-subscribe.

A step takes a DataFrame of messages and returns a DataFrame, or an ``Out`` with side outputs. Side outputs
are plans over the same input, so nothing is computed unless it is written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FlowError(ValueError):
    """A flow that can't be built."""


class NoRouteError(FlowError):
    """A router without a destination for some message."""


class SubscriptionError(FlowError):
    """A channel with no subscriber, or with a second one."""


@dataclass
class Out:
    """The main output of a step, its named side outputs, and what goes where at terminal steps."""

    main: DataFrame
    sides: dict[str, DataFrame] = field(default_factory=dict)
    ends: list[tuple[str, DataFrame, Callable[[DataFrame], None] | None]] = field(default_factory=list)


Step = Callable[[DataFrame], "DataFrame | Out"]


def chain(*steps: Step) -> Callable[[DataFrame], Out]:
    """Steps one after another; side outputs are collected, and of equal names united."""

    def run(df: DataFrame) -> Out:
        def one(done: Out, step: Step) -> Out:
            out = step(done.main)
            out = out if isinstance(out, Out) else Out(out)
            sides = dict(done.sides)
            for name, side in out.sides.items():
                sides[name] = sides[name].unionByName(side, allowMissingColumns=True) if name in sides else side
            return Out(out.main, sides, done.ends + out.ends)

        return reduce(one, steps, Out(df))

    return run


def filter_(predicate: Column, discard: str | None = None) -> Step:
    """Messages for which the predicate is true; all others optionally to a discard channel."""

    def run(df: DataFrame) -> DataFrame | Out:
        passed = df.where(predicate)
        return Out(passed, {discard: df.where(~F.coalesce(predicate, F.lit(False)))}) if discard else passed

    return run


def transform(payload: Column) -> Step:
    """Another payload; headers stay."""
    return lambda df: df.withColumn("payload", payload)


def activate(service: Callable[[DataFrame], DataFrame]) -> Step:
    """Call a service with the messages and go on with its reply."""
    return service


Sink = Callable[[DataFrame], None]


class NoSinkError(FlowError):
    """A terminal step without a sink."""


class NoFunctionError(FlowError):
    """A step without the function that it calls."""


def to(sink: Sink | None, name: str = "to") -> Step:
    """A terminal step: all messages go to the sink when the flow is delivered, none goes on. A missing sink is
    an error then, not before."""
    return lambda df: Out(df.limit(0), ends=[(name, df, sink)])


def consume(service: Callable[[DataFrame], None] | None, name: str = "consumed") -> Step:
    """A one-way call of a service for its effect; none goes on."""
    if service is None:
        raise NoFunctionError("nothing to call")
    return to(service, name)


def deliver(out: Out) -> None:
    """Write everything that reached a terminal step; the first sink that fails stops it."""
    for name, df, sink in out.ends:
        if sink is None:
            raise NoSinkError(f"{name}: no sink")
        sink(df)


def route(key: Column, routes: dict[str, str], default: str | None = None, column: str = "channel") -> Step:
    """Add the channel that ``routes`` names for the key; without one the default, else null.

    ``unrouted`` selects the messages that no route takes.
    """
    if not routes:
        raise FlowError("a router needs routes")
    if any(not v for v in routes.values()):
        raise FlowError("a route needs a channel")
    table = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv])
    return lambda df: df.withColumn(column, F.coalesce(F.try_element_at(table, key.cast("string")), F.lit(default)))


def unrouted(df: DataFrame, column: str = "channel") -> DataFrame:
    """Messages without a route: the error branch."""
    return df.where(F.col(column).isNull())


def branches(df: DataFrame, channels: list[str], column: str = "channel") -> dict[str, DataFrame]:
    """One plan for each channel."""
    return {c: df.where(F.col(column) == c) for c in channels}


def split(children: Column, parent_id: str = "message_id", correlation: str = "correlation_id") -> Step:
    """A message for each element, in order; no elements, no messages.

    Stamps sequence number and size, and of a parent with an id a child's id after it and, unless there is a
    correlation already (an empty one is one), the parent's id as correlation. Without a parent's id, id and
    correlation stay as they are.
    """

    def run(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_children", children)
        rows = rows.select(*df.columns, F.size("_children").alias("_size"), F.posexplode("_children").alias("_pos", "_child"))
        number = (F.col("_pos") + 1).cast("int")
        known = F.coalesce(F.col(parent_id) != "", F.lit(False))
        return rows.withColumns(
            {
                "sequence_number": number,
                "sequence_size": F.col("_size").cast("int"),
                correlation: F.when(known, F.coalesce(correlation, parent_id)).otherwise(F.col(correlation)),
                parent_id: F.when(known, F.concat_ws("#", F.col(parent_id), number.cast("string"))).otherwise(F.col(parent_id)),
                "payload": F.col("_child"),
            }
        ).drop("_children", "_size", "_pos", "_child")

    return run


class DirectChannel:
    """A named edge of a flow with exactly one subscriber."""

    def __init__(self, name: str) -> None:
        self.name, self._handler = name, None

    def subscribe(self, handler: Step) -> None:
        if handler is None:
            raise SubscriptionError(f"{self.name}: no handler given")
        if self._handler is not None:
            raise SubscriptionError(f"{self.name} has a subscriber already")
        self._handler = handler

    def send(self, df: DataFrame) -> DataFrame | Out:
        if self._handler is None:
            raise SubscriptionError(f"{self.name} has no subscriber")
        return self._handler(df)


class Topics:
    """Subscriptions by topic, in the order in which they were made; an empty topic is forgotten."""

    def __init__(self) -> None:
        self._next, self._of = 0, {}

    def subscribe(self, topic: str, name: str) -> int:
        self._next += 1
        self._of.setdefault(topic, {})[self._next] = name
        return self._next

    def cancel(self, topic: str, subscription: int) -> None:
        self._of.get(topic, {}).pop(subscription, None)
        if not self._of.get(topic, True):
            del self._of[topic]

    def count(self) -> int:
        return len(self._of)

    def publish(self, df: DataFrame, topic: Column) -> DataFrame:
        """A row for each message and subscriber of its topic; no subscriber, no row."""
        rows = [(t, n, s) for t, subs in self._of.items() for n, s in subs.items()]
        return publish(df, topic, df.sparkSession.createDataFrame(rows, "topic string, position int, subscriber string"))


def publish(df: DataFrame, topic: Column, subscriptions: DataFrame) -> DataFrame:
    """Fan out to ``subscriptions(topic, position, subscriber)`` by an equi-join."""
    return df.withColumn("_topic", topic).join(subscriptions.withColumnRenamed("topic", "_of"), F.col("_topic") == F.col("_of")).drop("_topic", "_of")


def fan_out_outcome(delivered: DataFrame, ok: Column, best_effort: bool = False) -> DataFrame:
    """Per message: acknowledged if all subscribers succeeded (or in any case with ``best_effort``), else
    retried to all; with the number that failed."""
    failed = F.sum(F.when(ok, 0).otherwise(1))
    outcome = F.lit("ack") if best_effort else F.when(failed == 0, "ack").otherwise("retry")
    return delivered.groupBy("message_id").agg(F.count("*").alias("n_subscribers"), failed.cast("long").alias("n_failed"), outcome.alias("outcome"))
