"""Leased queues over snapshot tables: claim, settle, schedule, deduplicate, purge, overflow.

A queue is a table ``(id, msg_id, headers, payload, locked_by, locked_at, visible_after, delivery_count,
lease_epoch, created_at)``. A claim or settlement yields the rows that change; one writer per queue applies
them (a micro-batch), which takes the place of row locks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folds import fold


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def claimable(queue: DataFrame, now: Column, lease_us: int) -> DataFrame:
    """Visible rows that are unlocked or whose lease has run out."""
    free = F.col("locked_at").isNull() | (_micros(F.col("locked_at")) <= _micros(now) - lease_us)
    return queue.where((F.col("visible_after") <= now) & free)


def claim(queue: DataFrame, now: Column, most: int, holder: str, lease_us: int = 300_000_000) -> DataFrame:
    """At most ``most`` rows, oldest visibility first, as they are after the claim: locked, with the next
    epoch and one more delivery. Ties are broken by id."""
    rows = claimable(queue, now, lease_us).orderBy("visible_after", "id").limit(most)
    return rows.withColumns({"locked_by": F.lit(holder), "locked_at": now, "lease_epoch": F.col("lease_epoch") + 1, "delivery_count": F.col("delivery_count") + 1})


def claim_locked(queue: DataFrame, now: Column, holder: str) -> DataFrame:
    """One row for a transaction held until it settles; unlocked rows only, an old lease doesn't count."""
    rows = queue.where((F.col("visible_after") <= now) & F.col("locked_at").isNull()).orderBy("visible_after", "id").limit(1)
    return rows.withColumns({"locked_by": F.lit(holder), "locked_at": now, "delivery_count": F.col("delivery_count") + 1})


def penalty_us(delivery_count: Column) -> Column:
    """How long a row with unreadable headers stays invisible: 30 s, doubled each time, an hour at most."""
    return (F.least(F.lit(30.0) * F.pow(F.lit(2.0), (delivery_count - 1).cast("double")), F.lit(3600.0)) * 1_000_000).cast("long")


def corrupt(claimed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Claimed rows that can be delivered, and those with unreadable headers, put back with a penalty."""
    bad = F.col("headers").isNotNull() & (F.col("headers") != "") & F.try_parse_json("headers").isNull()
    later = F.timestamp_micros(_micros(now) + penalty_us(F.col("delivery_count")))
    back = claimed.where(bad).withColumns({"visible_after": later, "locked_by": F.lit(None).cast("string"), "locked_at": F.lit(None).cast("timestamp")})
    return claimed.where(~bad), back


def settle(queue: DataFrame, events: DataFrame) -> DataFrame:
    """What settlement events ``(id, locked_by, lease_epoch, action, delay_us, at)`` do.

    ``ack`` deletes, ``nack`` returns the row after its delay (a drop without requeue is an immediate one);
    an event whose holder or epoch isn't the row's has a stale lease and does nothing.
    """
    q = queue.select("id", F.col("locked_by").alias("_by"), F.col("lease_epoch").alias("_epoch"))
    fits = F.coalesce((F.col("locked_by") == F.col("_by")) & (F.col("lease_epoch") == F.col("_epoch")), F.lit(False))
    result = F.when(~fits, "stale").when(F.col("action") == "ack", "deleted").otherwise("requeued")
    rows = events.join(q, "id", "left").withColumn("result", result)
    later = F.timestamp_micros(_micros(F.col("at")) + F.greatest(F.coalesce("delay_us", F.lit(0)), F.lit(0)))
    return rows.withColumn("visible_after", F.when(F.col("result") == "requeued", later)).drop("_by", "_epoch")


def visible_after(now: Column, delay_us: Column) -> Column:
    """When a message sent with a delay becomes visible; none or a negative one means now."""
    return F.timestamp_micros(_micros(now) + F.greatest(F.coalesce(delay_us, F.lit(0)), F.lit(0)))


def unprocessed(df: DataFrame, inbox: DataFrame, order: list[str], message_id: str = "message_id") -> DataFrame:
    """The first message of each id that the inbox doesn't have."""
    rank = F.row_number().over(Window.partitionBy(message_id).orderBy(*order))
    fresh = df.join(inbox.select(F.col("msg_id").alias("_id")), F.col(message_id) == F.col("_id"), "left_anti")
    return fresh.withColumn("_n", rank).where("_n = 1").drop("_n")


def purge(inbox: DataFrame, now: Column, older_us: int, at: str = "processed_at") -> DataFrame:
    """What stays of an inbox or a table of fires: all but what is strictly older."""
    if older_us <= 0:
        raise ValueError("the age must be positive")
    return inbox.where(~(_micros(F.col(at)) < _micros(now) - older_us))


def overflow(df: DataFrame, capacity: int, policy: str, order: list[str], queue: str) -> DataFrame:
    """The status of messages offered to bounded queues that nobody empties meanwhile.

    ``drop_newest`` and ``reject`` turn away what comes when the queue is full, ``drop_oldest`` evicts the
    head, ``block`` makes it wait.
    """
    by = Window.partitionBy(queue)
    place, n = F.row_number().over(by.orderBy(*order)), F.count(F.lit(1)).over(by)
    if policy == "drop_oldest":
        status = F.when(n - place < capacity, "accepted").otherwise("dropped")
    else:
        full = {"drop_newest": "dropped", "reject": "rejected", "block": "blocked"}[policy]
        status = F.when(place <= capacity, "accepted").otherwise(full)
    return df.withColumn("status", status)


def bounded_queue(log: DataFrame, capacity: int, policy: str, order: list[str], queue: str) -> DataFrame:
    """Add ``status`` and ``depth`` to a log ``(queue, id, command)`` of offers and settlements, in order: an
    offer to a full queue is ``dropped``, ``rejected`` or ``blocked`` by policy, or with ``drop_oldest`` taken
    while the head is evicted; a settlement of an id that the queue holds makes room (``settled``), any other
    is ``unknown``; the command ``head`` settles the oldest. A blocked offer is taken as soon as there is room,
    before later ones. ``depth`` is what the queue holds then, and that and what waits is its state."""
    full = {"drop_newest": "dropped", "reject": "rejected", "block": "blocked", "drop_oldest": "evicting"}[policy]

    def step(state: tuple | None, commands: list, ids: list) -> tuple[tuple, tuple]:
        held, waiting = state or ({}, [])
        statuses, depths = [], []
        for command, i in zip(commands, ids):
            i = next(iter(held), None) if command == "head" else i
            if command == "offer":
                if len(held) < capacity:
                    status = "accepted"
                    held[i] = None
                else:
                    status = full
                    if policy == "drop_oldest":
                        del held[next(iter(held))]
                        held[i] = None
                    elif policy == "block":
                        waiting.append(i)
            elif i in held:
                status = "settled"
                del held[i]
                if waiting:
                    held[waiting.pop(0)] = None
            else:
                status = "unknown"
            statuses.append(status)
            depths.append(len(held))
        return (held, waiting), (statuses, depths)

    return fold(log, queue, order, ["command", "id"], step, {"status": "string", "depth": "long"})


def scheduled(df: DataFrame, now: Column, delay_us: Column, headers: Column, payload: Column) -> DataFrame:
    """The rows that sending messages later inserts in a queue table: invisible until their delay has passed,
    unlocked, not delivered yet. Ids are the table's own and left out."""
    return df.select(
        F.col("message_id").alias("msg_id"), headers.alias("headers"), payload.cast("binary").alias("payload"), F.lit(None).cast("string").alias("locked_by"),
        F.lit(None).cast("timestamp").alias("locked_at"), visible_after(now, delay_us).alias("visible_after"), F.lit(0).alias("delivery_count"), F.lit(0).cast("bigint").alias("lease_epoch"), now.cast("timestamp").alias("created_at"),
    )


class QueueChannel:
    """A channel over a queue table: sending appends rows that are visible now, polling claims some."""

    def __init__(self, spark: SparkSession, table: str, lease_us: int = 300_000_000) -> None:
        if not table:
            raise ValueError("a queue channel needs a store")
        self.spark, self.table, self.lease_us = spark, table, lease_us

    def send(self, df: DataFrame, now: Column, delay_us: Column | None = None) -> None:
        rows = scheduled(df, now, delay_us if delay_us is not None else F.lit(0), F.col("headers"), F.col("payload"))
        rows.select(F.monotonically_increasing_id().alias("id"), *rows.columns).write.insertInto(self.table)

    def poll(self, now: Column, most: int, holder: str) -> DataFrame:
        if most < 1:
            raise ValueError("a poll takes at least one message")
        return claim(self.spark.table(self.table), now, most, holder, self.lease_us)


def next_poll(state: DataFrame, interval_us: int = 1_000_000, cap_us: int = 30_000_000) -> DataFrame:
    """Add ``wait_us`` to polls ``(failures, n)``: none while messages come, the interval when there are none,
    and after errors in a row the interval doubled for each, up to the cap."""
    backoff = F.least(F.lit(float(cap_us)), F.lit(float(interval_us)) * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(62)).cast("double")))
    return state.withColumn("wait_us", F.when(F.col("failures") > 0, backoff.cast("bigint")).when(F.col("n") > 0, 0).otherwise(interval_us).cast("bigint"))


def clamp(polled: DataFrame, most: int, order: list[str], poll: str) -> DataFrame:
    """Add ``taken``: of what a poll returned over its limit, the excess goes back."""
    place = F.row_number().over(Window.partitionBy(poll).orderBy(*order))
    return polled.withColumn("taken", place <= most)
