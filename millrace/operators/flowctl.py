"""Flow control: token buckets, circuit breakers, credits."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import cell_width, join_cells, with_cell
from .folds import fold


def token_bucket(df: DataFrame, source: str, at_us: str, order: list[str], rate: float, burst: int) -> DataFrame:
    """Add ``release_us``: when the bucket of the message's source lets it go, in order of arrival; ``order``
    begins with ``at_us``.

    A bucket starts full and holds ``burst`` tokens; with T the time of one token, message i is released at
    max(t_i, max over j < i of (t_j - j T) + i T - (burst - 1) T), a running maximum. Sources of many messages
    are cut in cells of time, of which a count and a maximum are carried on.
    """
    if rate <= 0 or burst < 1:
        raise ValueError("a bucket needs a rate above 0 and a burst of at least 1")
    period = round(1_000_000 / rate)
    width = cell_width(df, source, at_us)
    rows = df.withColumn("_cell", F.lit(0).cast("long")) if width is None else with_cell(df, at_us, width)
    by = Window.partitionBy(source, *([] if width is None else ["_cell"])).orderBy(*order)
    rows = rows.withColumn("_i", (F.row_number().over(by) - 1).cast("long")).withColumn("_free", F.col(at_us) - F.col("_i") * period)
    rows = rows.withColumn("_most", F.max("_free").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    if width is None:
        rows = rows.withColumns({"_base": F.lit(0).cast("long"), "_top": F.lit(None).cast("long")})
    else:
        along = Window.partitionBy(source).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = rows.groupBy(source, "_cell").agg(F.count("*").alias("_n"), F.max("_free").alias("_m"))
        cells = cells.withColumn("_base", F.coalesce(F.sum("_n").over(along), F.lit(0))).withColumn("_top", F.max(F.col("_m") - F.col("_base") * period).over(along))
        rows = join_cells(rows, cells, source, ["_base", "_top"])
    earlier = F.greatest("_top", F.col("_most") - F.col("_base") * period)
    release = F.greatest(F.col(at_us), F.coalesce(earlier + (F.col("_base") + F.col("_i") - (burst - 1)) * period, F.col(at_us)))
    return rows.withColumn("release_us", release).drop("_cell", "_i", "_free", "_most", "_base", "_top")


def breaker(df: DataFrame, source: str, at_us: str, order: list[str], healthy: str, threshold: int = 5, cooldown_us: int = 30_000_000) -> DataFrame:
    """Add ``admitted`` and the breaker's ``state`` after each call.

    Closed until ``threshold`` failures in a row; open for the cooldown; then one probe, which closes it or
    opens it again. What the breaker turns away isn't called and doesn't count.
    """

    def step(s: tuple | None, times: list, goods: list) -> tuple[tuple, tuple]:
        state, fails, since = s or ("closed", 0, 0)
        let_in, states = [], []
        for t, ok in zip(times, goods):
            if state == "open" and t - since >= cooldown_us:
                state = "half_open"
            admitted = state != "open"
            if admitted and ok:
                state, fails = "closed", 0
            elif admitted:
                fails = fails + 1 if state == "closed" else threshold
                if fails >= threshold:
                    state, since = "open", t
            let_in.append(admitted)
            states.append(state)
        return (state, fails, since), (let_in, states)

    return fold(df, source, order, [at_us, healthy], step, {"admitted": "boolean", "state": "string"})


def in_flight(df: DataFrame, source: str, claimed_us: str, settled_us: str, ids: str) -> DataFrame:
    """``(source, id, at_us, in_flight)`` after each claim: claims minus settlements up to then. Sources of
    many claims are cut in cells of time, of which the sum is carried on."""
    events = df.select(source, ids, F.explode(F.array(F.struct(F.col(claimed_us).alias("at_us"), F.lit(1).alias("d")), F.struct(F.col(settled_us).alias("at_us"), F.lit(-1).alias("d")))).alias("e"))
    events = events.select(source, ids, "e.at_us", "e.d")
    width = cell_width(df.where(F.col(claimed_us).isNotNull()), source, claimed_us)
    if width is None:
        by = Window.partitionBy(source).orderBy("at_us", "d", ids).rowsBetween(Window.unboundedPreceding, 0)
        return events.withColumn("in_flight", F.sum("d").over(by)).where("d = 1").drop("d")
    events = with_cell(events, "at_us", width)
    along = Window.partitionBy(source).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = events.groupBy(source, "_cell").agg(F.sum("d").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(along), F.lit(0)))
    by = Window.partitionBy(source, "_cell").orderBy("at_us", "d", ids).rowsBetween(Window.unboundedPreceding, 0)
    rows = join_cells(events.withColumn("_part", F.sum("d").over(by)), cells, source, ["_base"]).where("d = 1")
    return rows.withColumn("in_flight", F.col("_base") + F.col("_part")).drop("d", "_cell", "_base", "_part")


def credit_gate(df: DataFrame, source: str, claimed_us: str, settled_us: str, order: list[str], credits_: int) -> DataFrame:
    """Add ``start_us``: when a message that arrives at ``claimed_us`` is let in, at most ``credits_`` being in
    flight at once; it then takes as long as from its claim to its settlement. Messages are let in in order.

    Which credit is free depends on all earlier ends, so a source is folded in order, with the ends of at most
    ``credits_`` messages as state.
    """
    if credits_ < 1:
        raise ValueError("a gate needs a credit")

    def step(state: list | None, claims: list, settles: list) -> tuple[list, tuple]:
        ends, starts = state or [], []
        for claim, settle in zip(claims, settles):
            start = claim
            if len(ends) == credits_:
                start = max(claim, heapq.heappop(ends))
            heapq.heappush(ends, start + settle - claim)
            starts.append(start)
        return ends, (starts,)

    return fold(df, source, order, [claimed_us, settled_us], step, {"start_us": "long"})


def failure_runs(df: DataFrame, source: str, order: list[str], healthy: str) -> DataFrame:
    """Add ``run``: how many failures in a row end with this call."""
    by = Window.partitionBy(source).orderBy(*order)
    df = df.withColumn("_island", F.sum(F.col(healthy).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(source, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("run", F.sum((~F.col(healthy)).cast("long")).over(inside)).drop("_island")
