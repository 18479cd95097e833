"""Keyed aggregation of messages into groups, with release and timeout rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold


class AggregatorError(ValueError):
    """An aggregator that can't be built."""


@dataclass(frozen=True)
class Aggregator:
    """What an aggregator is made of, checked when it is made: a fold and an output are needed, a timeout
    needs a channel for expired groups, and expressions must compile (they are checked first).

    ``completion_size`` 0 releases by the first member's sequence size.
    """

    folds: dict[str, Column] | None
    output: str | None
    completion_size: int = 0
    timeout_us: int = 0
    expired: str | None = None
    correlation_expr: str | None = None
    release_expr: str | None = None
    schema: DataFrame | None = None

    def __post_init__(self) -> None:
        from millrace.functions.exprs import check_group_expression, compile_expression

        if self.folds is None:
            raise AggregatorError("an aggregator needs a fold")
        if self.correlation_expr is not None:
            compile_expression(self.correlation_expr, self.schema, "string")
        if self.release_expr is not None:
            check_group_expression(self.release_expr, self.schema)
        if not self.output:
            raise AggregatorError("an aggregator needs an output")
        if self.completion_size < 0 or self.timeout_us < 0:
            raise AggregatorError("sizes and timeouts must not be negative")
        if self.timeout_us and not self.expired:
            raise AggregatorError("a timeout needs a channel for expired groups")


def correlated(df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Messages with a group key, and those without one, which are invalid for good."""
    df = df.withColumn("group_key", key.cast("string"))
    missing = F.col("group_key").isNull() | (F.col("group_key") == "")
    return df.where(~missing), df.where(missing)


def correlated_expr(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages with a group key by a string expression, those whose key is empty (invalid for good), and
    those on which the expression failed (to be tried again)."""
    from millrace.functions.exprs import compile_expression

    e = compile_expression(text, df, "string")
    good, missing = correlated(df.where(~e.err), e.value)
    return good, missing, df.where(e.err)


def once(df: DataFrame, order: list[str], message_id: str = "message_id") -> DataFrame:
    """The first arrival of each id in its group; a repeated add changes nothing. For groups that are never
    settled in between; ``by_sequence_size`` and ``by_release`` forget ids with their group."""
    rank = F.row_number().over(Window.partitionBy("group_key", message_id).orderBy(*order))
    return df.withColumn("_n", rank).where("_n = 1").drop("_n")


def by_completion_size(df: DataFrame, n: int, order: list[str], folds: dict[str, Column]) -> DataFrame:
    """Batches of ``n`` in arrival order, again and again for the same key. ``released`` is false for the
    rest that is still held."""
    place = F.row_number().over(Window.partitionBy("group_key").orderBy(*order)).cast("long")
    rows = df.withColumn("batch", F.floor((place - 1) / n).cast("long"))
    done = rows.groupBy("group_key", "batch").agg(F.count("*").alias("n_members"), *[c.alias(k) for k, c in folds.items()])
    return done.withColumn("released", F.col("n_members") >= n)


def whole_groups(df: DataFrame, order: list[str], folds: dict[str, Column], size: str = "sequence_size") -> DataFrame:
    """One group per key, released when it has as many members as its first one says; without a size, never.

    For keys that can't get more members than that, as those of a split: one aggregation, no ranking.
    """
    first = F.min(F.struct(*order, F.col(size).alias("_size")))["_size"]
    done = df.groupBy("group_key").agg(F.count("*").alias("n_members"), first.alias("expected"), *[c.alias(k) for k, c in folds.items()])
    return done.withColumn("released", F.coalesce(F.col("n_members") >= F.col("expected"), F.lit(False)))


def batches_by_sequence_size(df: DataFrame, order: list[str], size: str = "sequence_size", message_id: str | None = None) -> DataFrame:
    """Add ``batch`` and ``expected`` to every message: a group is released as soon as it has the members that
    its first one says (a size of 0 or less: at once), and what comes later is a new group. A repeated
    ``message_id`` changes nothing while its group lives (batch null) and is forgotten with it."""

    def step(state: tuple | None, sizes: list, ids: list) -> tuple[tuple, tuple]:
        batch, live, expected, n = state or (0, set(), None, 0)
        found, wanted = [], []
        for s, i in zip(sizes, ids):
            if message_id and i in live:
                found.append(None)
                wanted.append(expected)
                continue
            expected = (None if s is None else int(s)) if not n else expected
            n += 1
            if message_id:
                live.add(i)
            found.append(batch)
            wanted.append(expected)
            if expected is not None and n >= expected:
                batch, live, expected, n = batch + 1, set(), None, 0
        return (batch, live, expected, n), (found, wanted)

    return fold(df, "group_key", order, [size, message_id or size], step, {"batch": "long", "expected": "long"})


def by_sequence_size(df: DataFrame, order: list[str], folds: dict[str, Column], size: str = "sequence_size", message_id: str | None = None) -> DataFrame:
    """Groups of as many members as their first one says, again and again for the same key; ``released`` is
    false for the rest that is still held, and for members whose first one has no size."""
    rows = batches_by_sequence_size(df, order, size, message_id).where("batch is not null")
    done = rows.groupBy("group_key", "batch").agg(F.count("*").alias("n_members"), F.max("expected").alias("expected"), *[c.alias(k) for k, c in folds.items()])
    return done.withColumn("released", F.coalesce(F.col("n_members") >= F.col("expected"), F.lit(False)))


def reap(groups: DataFrame, as_of: Column, timeout_us: int, created: str = "created_at") -> DataFrame:
    """One pass of the reaper over groups with ``released``: output, expired or held."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(created).cast("timestamp"))
    return groups.withColumn("fate", F.when(F.col("released"), "output").when(age > timeout_us, "expired").otherwise("held"))


def expired_members(members: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The members of the groups whose ``fate`` is expired, one by one, as they go to the expired channel."""
    gone = groups.where("fate = 'expired'").select(*[F.col(c).alias(f"_{c}") for c in by])
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return members.join(gone, same, "left_semi")


def until(df: DataFrame, order: list[str], value: str, enough: float, least: int = 1) -> DataFrame:
    """Groups released as soon as they have ``least`` members whose ``value`` adds up to ``enough``."""

    def step(state: tuple | None, values: list) -> tuple[tuple, tuple]:
        batch, n, total = state or (0, 0, 0.0)
        batches, places = [], []
        for v in values:
            n, total = n + 1, total + v
            batches.append(batch)
            places.append(n)
            if n >= least and total >= enough:
                batch, n, total = batch + 1, 0, 0.0
        return (batch, n, total), (batches, places)

    return fold(df, "group_key", order, [value], step, {"batch": "long", "place": "long"})


def with_timeout(df: DataFrame, time_us: str, timeout_us: int, n: int, order: list[str]) -> DataFrame:
    """Generations of a group: a new one after ``n`` members, or when a member comes later than ``timeout``
    after the generation's first."""

    def step(state: tuple | None, times: list) -> tuple[tuple, tuple]:
        generation, place, start = state or (0, 0, times[0])
        generations, places = [], []
        for t in times:
            if place >= n or t > start + timeout_us:
                generation, place, start = generation + 1, 0, t
            place += 1
            generations.append(generation)
            places.append(place)
        return (generation, place, start), (generations, places)

    return fold(df, "group_key", order, [time_us], step, {"generation": "long", "place": "long"})


def by_release_expr(df: DataFrame, order: list[str], text: str) -> DataFrame:
    """Add ``batch``, ``place``, ``complete`` and ``err`` by an expression over ``messages`` (the live members up
    to this one) and ``size`` (the first live member's sequence size, else 0). Where it is true the group is
    released and the next message begins a new one; an error leaves the group as it is, with this member.

    Needs ``headers``, ``payload`` and ``sequence_size``. The expression sees all live members each time, and a
    key's members are put in one array: for keys of many members there is ``by_release``.
    """
    from millrace.functions.exprs import compile_group_expression

    member = F.struct(F.struct(*order).alias("_o"), "headers", "payload", "sequence_size", F.struct(*df.columns).alias("_row"))
    # maps have no order, so members are compared by theirs alone
    earlier = lambda x, y: F.when(x["_o"] < y["_o"], -1).when(x["_o"] > y["_o"], 1).otherwise(0)
    groups = df.groupBy("group_key").agg(F.array_sort(F.collect_list(member), earlier).alias("_all"))
    one = "struct<headers: {}, payload: {}, sequence_size: {}>".format(*(df.schema[c].dataType.simpleString() for c in ("headers", "payload", "sequence_size")))
    mark = "struct<batch: bigint, place: bigint, complete: boolean, err: boolean>"
    state = F.struct(F.lit(0).cast("long").alias("batch"), F.expr(f"cast(array() as array<{one}>)").alias("live"), F.expr(f"cast(array() as array<{mark}>)").alias("marks"))

    def step(a: Column, x: Column) -> Column:
        grown = F.concat(a["live"], F.array(F.struct(x["headers"].alias("headers"), x["payload"].alias("payload"), x["sequence_size"].alias("sequence_size"))))

        def judged(live: Column) -> Column:
            e = compile_group_expression(text, live, F.coalesce(F.get(live, 0)["sequence_size"], F.lit(0)))
            done = F.coalesce(e.value, F.lit(False))
            marked = F.struct(a["batch"].alias("batch"), F.size(live).cast("long").alias("place"), done.alias("complete"), e.err.alias("err"))
            left = F.when(done, F.slice(live, 1, 0)).otherwise(live)
            return F.struct((a["batch"] + done.cast("long")).alias("batch"), left.alias("live"), F.concat(a["marks"], F.array(marked)).alias("marks"))

        return F.transform(F.array(grown), judged)[0]

    marks = groups.withColumn("_marks", F.aggregate("_all", state, step)["marks"])
    rows = marks.select(F.explode(F.arrays_zip(F.col("_all"), F.col("_marks"))).alias("_x"))
    return rows.select("_x._all._row.*", "_x._marks.*")


def by_release(df: DataFrame, order: list[str], predicate: Callable[[list[dict]], bool]) -> DataFrame:
    """Generations of a group released whenever an arbitrary predicate holds for its live members; only these
    are held in memory."""
    names = df.columns

    def step(state: tuple | None, *values: list) -> tuple[tuple, tuple]:
        batch, live = state or (0, [])
        batches, places = [], []
        for row in zip(*values):
            live.append(dict(zip(names, row)))
            batches.append(batch)
            places.append(len(live))
            if predicate(live):
                batch, live = batch + 1, []
        return (batch, live), (batches, places)

    return fold(df, "group_key", order, names, step, {"batch": "long", "place": "long"})
