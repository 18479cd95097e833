"""Leased message groups as a command log: add, claim, settle, abandon, in order per group key.

The log takes the place of row locks: commands of a key are folded in order by one task, keys run in
parallel. A claim hands out the members that are there and raises the epoch; settling with that epoch
removes just those members (what came meanwhile stays as a new group), any other epoch is stale; a claim that
is never settled can be taken again once its lease is over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold

LEASE_US = 300_000_000
SCAN_LIMIT = 100


def replay(log: DataFrame, order: list[str], lease_us: int = LEASE_US) -> DataFrame:
    """Add ``result``, ``members`` (live or claimed, comma-joined), ``epoch`` and ``created_us`` to a log
    ``(group_key, command, message_id, epoch_given, at_us)``."""

    def step(s: tuple | None, commands: list, ids: list, given: list, times: list) -> tuple[tuple, tuple]:
        members, epoch, locked, created = s or ({}, 0, None, None)
        results, listed, epochs, births = [], [], [], []
        for command, message_id, epoch_given, t in zip(commands, ids, given, times):
            fits = epoch_given == epoch and locked is not None
            if command == "add":
                if not message_id:
                    result = "invalid"
                elif message_id in members:
                    result = "repeated"
                else:
                    created = t if created is None else created
                    members[message_id] = None
                    result = "added"
            elif command == "claim":
                if not members or (locked is not None and t - locked < lease_us):
                    result = "nothing"
                else:
                    epoch, locked, result = epoch + 1, t, "claimed"
                    members = dict.fromkeys(members, epoch)
            elif not fits:
                result = "stale"
            elif command == "settle":
                members = {m: None for m, e in members.items() if e != epoch}
                locked, created, result = None, t if members else None, "settled"
            else:
                locked, result = None, "abandoned"
            results.append(result)
            listed.append(",".join(members))
            epochs.append(epoch)
            births.append(created)
        return (members, epoch, locked, created), (results, listed, epochs, births)

    return fold(log, "group_key", order, ["command", "message_id", "epoch_given", "at_us"], step, {"result": "string", "members": "string", "epoch": "long", "created_us": "long"})


def claimed_members(log: DataFrame, members: DataFrame, order: list[str], lease_us: int = LEASE_US) -> DataFrame:
    """The members that each successful claim of a command log hands out, with the claim's epoch, in order of
    ``seq`` and id: ``members(group_key, message_id, seq, ...)`` joined by key and id."""
    claims = replay(log, order, lease_us).where("result = 'claimed'")
    wanted = claims.select(F.col("group_key").alias("_key"), "epoch", F.explode(F.split("members", ",")).alias("_id"))
    return members.join(wanted, (F.col("group_key") == F.col("_key")) & (F.col("message_id") == F.col("_id"))).drop("_key", "_id")


def expired(groups: DataFrame, now_us: int, timeout_us: int, most: int = SCAN_LIMIT) -> DataFrame:
    """At most ``most`` groups that are strictly older than the timeout, the oldest first."""
    return groups.where(F.col("created_us") < now_us - timeout_us).orderBy("created_us", "group_key").limit(most)


def admitted(df: DataFrame, store: str, order: list[str], capacity: int) -> DataFrame:
    """Add ``admitted``: whether the message's group found room in a store of ``capacity`` live groups that
    nothing leaves meanwhile.

    One row a group is ranked by first arrival; only the first ``capacity`` of a store reach its task, and
    they are joined back.
    """
    first = df.groupBy(store, "group_key").agg(F.min(F.struct(*order)).alias("_first"))
    place = F.row_number().over(Window.partitionBy(store).orderBy("_first", "group_key"))
    first = first.withColumn("_n", place).where(F.col("_n") <= capacity).select(F.col(store).alias("_store"), F.col("group_key").alias("_key"), F.lit(True).alias("admitted"))
    rows = df.join(first, F.col(store).eqNullSafe(F.col("_store")) & F.col("group_key").eqNullSafe(F.col("_key")), "left")
    return rows.withColumn("admitted", F.coalesce("admitted", F.lit(False))).drop("_store", "_key")


def bounded_store(log: DataFrame, store: str, order: list[str], capacity: int) -> DataFrame:
    """Add ``admitted`` to a log ``(store, group_key, command)`` of adds and settles: a new group is taken while
    fewer than ``capacity`` live ones are held, a settled group leaves room again. Members of live groups are
    always taken; the state of a store is its live keys."""

    def step(live: set | None, commands: list, keys: list) -> tuple[set, tuple]:
        live, found = live or set(), []
        for command, key in zip(commands, keys):
            if command == "settle":
                found.append(key in live)
                live.discard(key)
            else:
                found.append(key in live or len(live) < capacity)
                if found[-1]:
                    live.add(key)
        return live, (found,)

    return fold(log, store, order, ["command", "group_key"], step, {"admitted": "boolean"})
