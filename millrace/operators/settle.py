"""Settlement: what happens to a message after its handler, and when it is tried again."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACK, INVALID, DEAD, RETRY = "ack", "invalid", "dead_letter", "retry"


#: Seconds that a delay in 64 bits of nanoseconds can't reach.
LONGEST = (1 << 63) / 1_000_000_000


@dataclass(frozen=True)
class Backoff:
    """Exponential delays in seconds, spread by a share of ``jitter`` to either side (0: none, so that plans
    can be compared); ``seed`` fixes the spread."""

    initial: float
    multiplier: float = 2.0
    most: float = 0.0
    jitter: float = 0.0
    seed: int | None = None

    def delay(self, attempt: Column) -> Column:
        """The delay before the attempt with this index, from 0: no longer than ``most`` if that is set, also
        after the spread. What is too long for a delay is ``most``, or the initial one."""
        if self.initial <= 0:
            return F.lit(0.0)
        n = F.greatest(attempt.cast("double"), F.lit(0.0))
        grown = F.lit(float(self.initial)) * F.pow(F.lit(float(self.multiplier if self.multiplier > 0 else 1.0)), n)
        fits = (grown < F.lit(LONGEST)) & ~F.isnan(grown)
        found = F.when(fits, grown).otherwise(F.lit(float(self.most if self.most > 0 else self.initial)))
        if self.most > 0:
            found = F.least(F.lit(float(self.most)), found)
        if self.jitter > 0:
            spread = F.rand(self.seed) if self.seed is not None else F.rand()
            found = F.least(F.greatest(found * (1 - self.jitter + spread * (2 * self.jitter)), F.lit(0.0)), F.lit(LONGEST))
            found = F.least(F.lit(float(self.most)), found) if self.most > 0 else found
        return found


class Strategy(Protocol):
    """What a policy needs of a backoff: the delay before the attempt with this index, from 0."""

    def delay(self, attempt: Column) -> Column: ...


@dataclass(frozen=True)
class RetryPolicy:
    """Attempts and their delays; 0 attempts means for ever, a finite number needs a dead-letter sink."""

    backoff: Strategy
    max_attempts: int = 0
    dead_letter: bool = False

    def __post_init__(self) -> None:
        if self.max_attempts < 0:
            raise ValueError("attempts must not be negative")
        if self.max_attempts and not self.dead_letter:
            raise ValueError("a finite number of attempts needs a dead-letter sink")


def attempt_number(delivery_count: Column, message_id: str, order: list[str]) -> Column:
    """The source's own count if it has one, else the place among the deliveries of the same id."""
    seen = F.row_number().over(Window.partitionBy(message_id).orderBy(*order))
    return F.coalesce(delivery_count, seen)


def attempt_with_ttl(df: DataFrame, message_id: str, at_us: str, order: list[str], ttl_us: int) -> DataFrame:
    """Add ``attempt``: the place among the deliveries of an id, which is forgotten when idle for the TTL."""
    by = Window.partitionBy(message_id).orderBy(*order)
    fresh = F.coalesce((F.col(at_us) - F.lag(at_us).over(by) >= ttl_us).cast("int"), F.lit(0))
    df = df.withColumn("_fresh", fresh).withColumn("_life", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("attempt", F.row_number().over(Window.partitionBy(message_id, "_life").orderBy(*order))).drop("_fresh", "_life")


def timed_out(elapsed_us: Column, limit_us: int) -> Column:
    """A handler over its time is a transient error; no limit, none."""
    return F.when(elapsed_us > limit_us, "transient") if limit_us > 0 else F.lit(None).cast("string")


def observed(settled: DataFrame, name: str) -> DataFrame:
    """Count outcomes as the plan runs, for listeners; the rows are unchanged."""
    return settled.observe(name, *[F.sum((F.col("outcome") == o).cast("long")).alias(o) for o in (ACK, INVALID, DEAD, RETRY)])


def settle(df: DataFrame, error: Column, attempt: Column, policy: RetryPolicy, decode_error: Column | None = None, native_dead_letter: bool = False) -> DataFrame:
    """Add ``outcome`` and ``delay``. ``error`` is null, ``permanent``, ``transient`` or ``retry_after``."""
    dead = F.lit(False)
    if policy.max_attempts and not native_dead_letter:
        dead = attempt >= policy.max_attempts
    bad = decode_error if decode_error is not None else F.lit(False)
    outcome = F.when(bad, INVALID).when(error.isNull(), ACK).when(error == "permanent", INVALID).when(dead, DEAD).otherwise(RETRY)
    df = df.withColumn("outcome", outcome)
    return df.withColumn("delay", F.when(F.col("outcome") == RETRY, policy.backoff.delay(attempt - 1)))


def divert(settled: DataFrame, refused: Column, attempt: Column, policy: RetryPolicy) -> DataFrame:
    """What becomes of settled messages whose invalid or dead-letter sink refuses them: they were not diverted,
    so they are tried again after a backoff. Adds ``diverted`` and ``event``, the hook that is called for the
    message: ``acked``, ``invalid``, ``dead_lettered`` or ``retried``."""
    bound = F.col("outcome").isin(INVALID, DEAD)
    back = bound & F.coalesce(refused, F.lit(False))
    rows = settled.withColumn("diverted", bound & ~back)
    rows = rows.withColumn("delay", F.when(back, policy.backoff.delay(attempt - 1)).otherwise(F.col("delay")))
    rows = rows.withColumn("outcome", F.when(back, RETRY).otherwise(F.col("outcome")))
    event = F.when(F.col("outcome") == ACK, "acked").when(F.col("outcome") == INVALID, "invalid").when(F.col("outcome") == DEAD, "dead_lettered").otherwise("retried")
    return rows.withColumn("event", event)


def payload_too_large(payload: Column, most: int) -> Column:
    """Wire payloads over the cap are a permanent error."""
    return F.octet_length(payload) > most


def healthy(error: Column) -> Column:
    """Whether an outcome counts as success for a circuit breaker: only transient errors don't."""
    return error.isNull() | (error == "permanent")


@dataclass(frozen=True)
class ProducerRetry:
    """A producer's own attempts, in seconds."""

    backoff: Strategy
    max_attempts: int = 0
    budget: float = 120.0
    retry_after_cap: float = 60.0
    least_wait: float = 0.1

    def __post_init__(self) -> None:
        if self.max_attempts <= 0 and self.budget <= 0:
            raise ValueError("attempts or budget must be bounded")

    def most_attempts(self) -> int | None:
        """A number of attempts that no message exceeds; None if neither attempts nor budget over the shortest wait give one."""
        bounds = [self.max_attempts] if self.max_attempts > 0 else []
        shortest, b = self.least_wait, self.backoff
        if isinstance(b, Backoff) and b.initial > 0 and b.multiplier >= 1 and not b.jitter:
            shortest = max(shortest, min(b.initial, b.most or b.initial))
        if self.budget > 0 and shortest > 0:
            # the one whose wait overruns is the last; one more for rounding of the sum of waits
            bounds.append(int(self.budget / shortest) + 3)
        return min(bounds, default=None)


def producer_schedule(df: DataFrame, failures: str, server_wait: str, policy: ProducerRetry) -> DataFrame:
    """Every attempt of a message that fails transiently ``failures`` times: ``attempt``, ``wait`` before the
    next one, ``at`` (seconds since the first), ``result`` (``sent``, ``wait``, ``dead_letter``).

    A wait is the longest of backoff, the server's wish (capped) and the least wait; an attempt whose wait
    would overrun the budget is the last.
    """
    most, attempts = policy.most_attempts(), F.col(failures).cast("long") + 1
    rows = df.withColumn("attempt", F.explode(F.sequence(F.lit(1), (attempts if most is None else F.least(attempts, F.lit(most))).cast("int"))))
    wished = F.least(F.coalesce(F.col(server_wait), F.lit(0.0)), F.lit(policy.retry_after_cap))
    wait = F.greatest(policy.backoff.delay(F.col("attempt") - 1), wished, F.lit(policy.least_wait))
    by = Window.partitionBy("message_id").orderBy("attempt")
    rows = rows.withColumn("wait", wait).withColumn("at", F.coalesce(F.sum("wait").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    over = (F.col("at") + F.col("wait") > policy.budget) if policy.budget > 0 else F.lit(False)
    # attempts after the first one that may not wait any more don't happen
    spent = F.col("attempt") >= policy.max_attempts if policy.max_attempts > 0 else F.lit(False)
    rows = rows.withColumn("_last", (over | spent) & (F.col("attempt") <= F.col(failures)))
    gone = F.coalesce(F.max(F.col("_last").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_gone", gone).where("_gone = 0")
    result = F.when(F.col("attempt") > F.col(failures), "sent").when(F.col("_last"), DEAD).otherwise("wait")
    return rows.withColumn("result", result).withColumn("wait", F.when(result == "wait", F.col("wait"))).drop("_last", "_gone")
