import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import flowctl, queue, settle
from millrace.operators.settle import Backoff, ProducerRetry, RetryPolicy


def delays(spark, backoff, n):
    df = spark.range(n).select(backoff.delay(F.col("id")).alias("d"))
    return [r.d for r in df.collect()]


def test_backoff(spark):
    assert delays(spark, Backoff(1, 2, 5), 4) == [1, 2, 4, 5]
    assert delays(spark, Backoff(0, 2, 5), 2) == [0, 0]
    assert delays(spark, Backoff(3, 0), 3) == [3, 3, 3]
    assert delays(spark, Backoff(1, 10), 400)[-1] == 1
    assert delays(spark, Backoff(1, 10, 60), 400)[-1] == 60


def test_policies_are_checked():
    for bad in ({"max_attempts": -1}, {"max_attempts": 3}):
        with pytest.raises(ValueError):
            RetryPolicy(Backoff(1), **bad)
    with pytest.raises(ValueError):
        ProducerRetry(Backoff(1), 0, 0)


def test_every_message_has_one_outcome(spark):
    df = spark.range(60).withColumn("err", F.when(F.col("id") % 3 == 1, "permanent").when(F.col("id") % 3 == 2, "transient"))
    done = settle.settle(df, F.col("err"), (F.col("id") % 4).cast("int") + 1, RetryPolicy(Backoff(1), 3, True))
    got = {r.outcome: r["count"] for r in done.groupBy("outcome").count().collect()}
    assert sum(got.values()) == 60 and got["ack"] == 20 and got["invalid"] == 20 and got["dead_letter"] + got["retry"] == 20
    assert done.where("outcome = 'retry' and delay is null or outcome <> 'retry' and delay is not null").count() == 0


def test_producer_gives_up_before_its_budget(spark):
    m = spark.createDataFrame([("a", 9, 50.0), ("b", 1, None), ("c", 0, None)], "message_id string, fails int, wish double")
    got = {}
    for r in settle.producer_schedule(m, "fails", "wish", ProducerRetry(Backoff(1), 0, 120.0)).orderBy("attempt").collect():
        got.setdefault(r.message_id, []).append((r.attempt, r["at"], r.result))
    assert got == {"a": [(1, 0.0, "wait"), (2, 50.0, "wait"), (3, 100.0, "dead_letter")], "b": [(1, 0.0, "wait"), (2, 1.0, "sent")], "c": [(1, 0.0, "sent")]}


def test_only_the_policy_ends_a_schedule(spark):
    m = spark.createDataFrame([("a", 100, None), ("b", 10**9, None)], "message_id string, fails int, wish double")
    got = {r.message_id: r for r in settle.producer_schedule(m, "fails", "wish", ProducerRetry(Backoff(0.125, 1.0), 0, 120.0, least_wait=0.125)).where("result <> 'wait'").collect()}
    assert (got["a"].attempt, got["a"].result) == (101, "sent")
    assert (got["b"].attempt, got["b"]["at"], got["b"].result) == (961, 120.0, "dead_letter")
    capped = settle.producer_schedule(m, "fails", "wish", ProducerRetry(Backoff(0.125, 1.0), 70, 120.0)).where("result <> 'wait'").collect()
    assert {(r.message_id, r.attempt, r.result) for r in capped} == {("a", 70, "dead_letter"), ("b", 70, "dead_letter")}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=25), st.integers(1, 4))
def test_token_bucket_matches_a_simulation(spark, gaps, burst):
    t, times = 0, []
    for g in gaps:
        t += g * 100_000
        times.append(t)
    df = spark.createDataFrame(list(enumerate(times)), "id long, at long").withColumn("s", F.lit(1))
    got = [r.release_us for r in flowctl.token_bucket(df, "s", "at", ["at", "id"], 1.0, burst).orderBy("id").collect()]
    tokens, last, want = float(burst), times[0], []
    for t in times:
        now = max(t, last)
        tokens = min(burst, tokens + (now - last) / 1e6)
        if tokens < 1 - 1e-9:
            now += (1 - tokens) * 1e6
            tokens = 1.0
        tokens -= 1
        last = now
        want.append(now)
    assert all(math.isclose(a, b, abs_tol=5) for a, b in zip(got, want))


def test_token_bucket_is_checked(spark):
    for rate, burst in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            flowctl.token_bucket(spark.range(1), "id", "id", ["id"], rate, burst)


def test_breaker(spark):
    calls = [(1, 0, False), (2, 1, False), (3, 2, True), (4, 15, False), (5, 16, True), (6, 40, True), (7, 41, False), (8, 42, False), (9, 43, True)]
    df = spark.createDataFrame([("s", *c) for c in calls], "src string, id long, at long, ok boolean")
    got = [(r.admitted, r.state) for r in flowctl.breaker(df, "src", "at", ["at"], "ok", 2, 10).orderBy("id").collect()]
    assert got == [(True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed"), (True, "open"), (False, "open")]


def test_claims_and_fences(spark):
    now = F.lit("2020-01-01 01:00:00").cast("timestamp")
    q = spark.sql("""select id, cast(id as string) msg_id, '{}' headers, if(id = 2, 'w', null) locked_by, if(id = 2, timestamp '2020-01-01 00:59:00', if(id = 3, timestamp '2020-01-01 00:50:00', null)) locked_at,
      if(id = 4, timestamp '2020-01-01 02:00:00', timestamp '2020-01-01 00:00:00') visible_after, 0 delivery_count, 5L lease_epoch from range(1, 6)""")
    got = queue.claim(q, now, 10, "me").orderBy("id").collect()
    assert [(r.id, r.lease_epoch, r.delivery_count, r.locked_by) for r in got] == [(1, 6, 1, "me"), (3, 6, 1, "me"), (5, 6, 1, "me")]
    assert [r.id for r in queue.claim_locked(q, now, "me").collect()] == [1]
    events = spark.sql("select 2L id, 'w' locked_by, 5L lease_epoch, 'ack' action, 0L delay_us, timestamp '2020-01-01 01:00:00' at union all select 2L, 'w', 4L, 'ack', 0L, timestamp '2020-01-01 01:00:00' union all select 1L, 'w', 5L, 'nack', 0L, timestamp '2020-01-01 01:00:00'")
    assert sorted(r.result for r in queue.settle(q, events).collect()) == ["deleted", "stale", "stale"]


def test_overflow_and_purge(spark):
    df = spark.range(5).withColumn("q", F.lit(1))
    status = lambda p: [r.status for r in queue.overflow(df, 2, p, ["id"], "q").orderBy("id").collect()]
    assert status("drop_newest") == ["accepted"] * 2 + ["dropped"] * 3
    assert status("drop_oldest") == ["dropped"] * 3 + ["accepted"] * 2
    assert status("reject")[-1] == "rejected" and status("block")[-1] == "blocked"
    with pytest.raises(ValueError):
        queue.purge(df, F.lit(None), 0)
