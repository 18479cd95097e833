"""Scheduled sources: fire grids from cron specifications, single-fire gates, leader leases."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import envelope
from millrace.operators.folds import fold

DESCRIPTORS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
DAYS = {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())}
UNITS = {"h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


class InvalidScheduleError(ValueError):
    """A specification that can't be read or never fires."""


@dataclass(frozen=True)
class Schedule:
    """Allowed values of each field, or a fixed interval in seconds."""

    seconds: frozenset[int] = frozenset({0})
    minutes: frozenset[int] = frozenset()
    hours: frozenset[int] = frozenset()
    days: frozenset[int] = frozenset()
    months: frozenset[int] = frozenset()
    weekdays: frozenset[int] = frozenset()
    either_day: bool = False
    every: int | None = None


def _field(text: str, low: int, high: int, names: dict[str, int] | None = None) -> frozenset[int]:
    found: set[int] = set()
    for part in text.lower().split(","):
        m = re.fullmatch(r"(\*|\?|\w+)(?:-(\w+))?(?:/(\d+))?", part)
        if not m:
            raise InvalidScheduleError(f"can't read {part!r}")
        value = lambda v: (names or {}).get(v, int(v) if v.isdigit() else -1)
        star = m[1] in "*?"
        first = low if star else value(m[1])
        last = high if star or (m[3] and not m[2]) else value(m[2]) if m[2] else first
        step = int(m[3] or 1)
        if not low <= first <= last <= high or not step:
            raise InvalidScheduleError(f"{part!r} is out of range")
        found.update(range(first, last + 1, step))
    return frozenset(found)


def _starred(field: str) -> bool:
    """Whether a field of days leaves them open; one with a step above 1 does not."""
    parts = (part.partition("/") for part in field.split(","))
    return any(first in ("*", "?") and (not step or int(step) == 1) for first, _, step in parts)


def parse(spec: str, with_seconds: bool = False) -> Schedule:
    """Five fields (six with seconds), a descriptor, or ``@every`` with a duration."""
    spec = spec.strip()
    if spec.startswith("@every "):
        text = spec[7:].strip()
        found = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ms|us|µs|ns|h|m|s)", text)
        total = sum(float(a) * UNITS[b] for a, b in found)
        if not found or "".join(a + b for a, b in found) != text or total <= 0:
            raise InvalidScheduleError(f"can't read {spec!r}")
        # whole seconds, one at least
        return Schedule(every=max(1, int(total + 1e-9)))
    if spec.startswith("@"):
        if spec not in DESCRIPTORS:
            raise InvalidScheduleError(f"unknown {spec!r}")
        spec, with_seconds = DESCRIPTORS[spec], False
    fields = spec.split()
    if len(fields) != 5 + with_seconds:
        raise InvalidScheduleError(f"{spec!r} has {len(fields)} fields")
    seconds = _field(fields[0], 0, 59) if with_seconds else frozenset({0})
    minute, hour, day, month, weekday = fields[-5:]
    both = not _starred(day) and not _starred(weekday)
    schedule = Schedule(seconds, _field(minute, 0, 59), _field(hour, 0, 23), _field(day, 1, 31), _field(month, 1, 12, MONTHS), _field(weekday, 0, 6, DAYS), both)
    longest = {2: 29, 4: 30, 6: 30, 9: 30, 11: 30}
    if not both and all(min(schedule.days) > longest.get(m, 31) for m in schedule.months):
        raise InvalidScheduleError(f"{spec!r} never fires")
    return schedule


def fires(spark: SparkSession, schedule: Schedule, start: str, end: str, zone: str = "UTC") -> DataFrame:
    """``fire_ts`` (UTC) of every fire after ``start`` up to ``end``, made in parallel from a range of ids;
    fields are read on the clock of ``zone``."""
    span = spark.sql(f"select unix_seconds(timestamp '{start} UTC') a, unix_seconds(timestamp '{end} UTC') b").first()
    step = schedule.every or (60 if schedule.seconds == {0} else 1)
    base = span.a if schedule.every else span.a - span.a % step
    grid = spark.range(base + step, span.b + 1, step).select(F.timestamp_seconds("id").alias("fire_ts"))
    if schedule.every:
        return grid.select(F.col("fire_ts").cast("timestamp_ntz").alias("fire_ts"))
    t = F.from_utc_timestamp("fire_ts", zone)
    day, weekday = F.dayofmonth(t).isin(list(schedule.days)), (F.dayofweek(t) - 1).isin(list(schedule.weekdays))
    # when both days are given, either one is enough
    fits = F.minute(t).isin(list(schedule.minutes)) & F.hour(t).isin(list(schedule.hours)) & F.month(t).isin(list(schedule.months))
    fits &= (day | weekday) if schedule.either_day else (day & weekday)
    return grid.where(fits & F.second(t).isin(list(schedule.seconds))).select(F.col("fire_ts").cast("timestamp_ntz").alias("fire_ts"))


def messages(fired: DataFrame, factory: Callable[[Column], Column] | None, scope: str) -> DataFrame:
    """A message for each fire: the payload that the factory makes of its time, and an id of scope and time,
    so the same fire has the same id wherever it is made."""
    if factory is None:
        raise InvalidScheduleError("a schedule needs a factory of payloads")
    at = F.col("fire_ts")
    return envelope.new(fired, factory(at), F.concat(F.lit(f"{scope}@"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")), at)


def single_fire(claims: DataFrame, order: list[str]) -> DataFrame:
    """Of claims ``(scope, fire_ts, ...)`` the first of each fire wins."""
    rank = F.row_number().over(Window.partitionBy("scope", "fire_ts").orderBy(*order))
    return claims.withColumn("won", rank == 1)


def elect(claims: DataFrame, at_us: str, order: list[str], lease_us: int = 30_000_000) -> DataFrame:
    """Add ``leader`` to claims ``(scope, holder, ...)``: a lease is taken if there is none, if it is one's
    own (and then extended) or if it has run out."""

    def step(state: tuple | None, times: list, holders: list) -> tuple[tuple, tuple]:
        leaders, untils = [], []
        for t, holder in zip(times, holders):
            won = state is None or state[0] == holder or state[1] <= t
            if won:
                state = (holder, t + lease_us)
            leaders.append(won)
            untils.append(state[1])
        return state, (leaders, untils)

    return fold(claims, "scope", order, [at_us, "holder"], step, {"leader": "boolean", "until_us": "long"})


def validate_gates(schedule: Schedule, locker: bool, elector: bool) -> None:
    """Gates that exclude each other."""
    if locker and elector:
        raise InvalidScheduleError("a locker and an elector exclude each other")
    if locker and schedule.every:
        raise InvalidScheduleError("a locker needs fixed fire times")
