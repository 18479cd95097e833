"""Request and reply: correlation, timeouts, late and unmatched replies, gateways."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import fold

REPLY_TIMEOUT_US = 30_000_000


def correlate(requests: DataFrame, replies: DataFrame, timeout_us: int = REPLY_TIMEOUT_US) -> DataFrame:
    """Each request of ``(request_id, correlation_id, sent_at)`` with its reply ``(reply_id, correlation_id,
    replied_at)``: the first that comes within the timeout. ``result`` is ``replied`` or ``timeout``, and
    ``duplicate`` for a correlation id that is in flight already.

    An id is in flight from an accepted request until its reply or its timeout and is free again then; at one
    time requests come before replies. Requests and replies of an id are folded in order of time.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ids = {"request_id": requests.schema["request_id"].dataType, "reply_id": replies.schema["reply_id"].dataType}
    none = lambda c: F.lit(None).cast(ids[c]).alias(c)
    asked = requests.select("correlation_id", micros("sent_at").alias("_at"), F.lit(0).alias("_kind"), "request_id", none("reply_id"), F.col("sent_at").alias("_time"))
    told = replies.select("correlation_id", micros("replied_at").alias("_at"), F.lit(1).alias("_kind"), none("request_id"), "reply_id", F.col("replied_at").alias("_time"))

    def step(state: tuple | None, times: list, kinds: list) -> tuple[tuple, tuple]:
        # the number of the request in flight, when it ends, and how many requests there were
        number, until, n = state or (None, 0, 0)
        numbers, fates = [], []
        for t, kind in zip(times, kinds):
            busy = number is not None and t <= until
            if kind == 0:
                n += 1
                numbers.append(n)
                fates.append("duplicate" if busy else "accepted")
                if not busy:
                    number, until = n, t + timeout_us
            else:
                numbers.append(number if busy else None)
                fates.append("matched" if busy else "unmatched")
                number = None if busy else number
        return (number, until, n), (numbers, fates)

    events = fold(asked.unionByName(told), "correlation_id", ["_at", "_kind", "request_id", "reply_id"], ["_at", "_kind"], step, {"_number": "long", "_fate": "string"})
    first = lambda c, kind: F.max(F.when(F.col("_kind") == kind, F.col(c)))
    known = events.where("_number is not null").groupBy("correlation_id", "_number")
    got = known.agg(first("request_id", 0).alias("request_id"), first("_time", 0).alias("sent_at"), first("_fate", 0).alias("_fate"), first("reply_id", 1).alias("reply_id"), first("_time", 1).alias("replied_at"))
    result = F.when(F.col("_fate") == "duplicate", "duplicate").when(F.col("reply_id").isNull(), "timeout").otherwise("replied")
    return got.select("request_id", "correlation_id", "sent_at", "reply_id", "replied_at", result.alias("result"))


def unmatched(replies: DataFrame, correlated: DataFrame) -> DataFrame:
    """Replies that no request took: late, repeated or unknown."""
    taken = correlated.where("reply_id is not null").select(F.col("reply_id").alias("_taken"))
    return replies.join(taken, F.col("reply_id") == F.col("_taken"), "left_anti")


def outbound(df: DataFrame, key: Column) -> DataFrame:
    """Set a correlation id of its own for an exchange in mid-flow, and keep the caller's."""
    return df.withColumn("saved_correlation_id", F.col("correlation_id")).withColumn("correlation_id", key)


def fresh_key(message_id: str) -> Column:
    """A correlation key of a request's own, that no other request has and no caller can guess from outside
    a session: a digest of the id and of a secret of this plan. The same plan gives the same key again, so a
    task that is run anew sends no second request."""
    secret = uuid.uuid4().hex
    return F.substring(F.sha2(F.concat_ws(":", F.lit(secret), F.col(message_id)), 256), 1, 32)


def gateway(sent: DataFrame, correlated: DataFrame, replies: DataFrame) -> DataFrame:
    """The messages of ``outbound`` with ``key`` (their key in the exchange), the result of the exchange, the
    columns of their reply, and the caller's correlation id."""
    done = correlated.select(F.col("request_id").alias("_of"), F.col("reply_id"), "replied_at", "result")
    rows = sent.withColumn("key", F.col("correlation_id")).join(done, F.col("message_id") == F.col("_of"), "left").drop("_of")
    return restore(rows.join(replies, "reply_id", "left"))


def restore(df: DataFrame) -> DataFrame:
    """Give the caller's correlation id back; without one the message has none again."""
    return df.withColumn("correlation_id", F.col("saved_correlation_id")).drop("saved_correlation_id")
