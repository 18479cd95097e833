"""Queries of settlement, retry, queue and flow-control operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import flowctl, groupstore, queue, settle
from millrace.operators.settle import Backoff, ProducerRetry, RetryPolicy

from .base import query, read

NOW = "1995-06-01 00:00:00"
ERROR_SQL = "case event_id % 7 when 0 then 'permanent' when 1 then 'transient' when 2 then 'transient' when 3 then 'retry_after' end"


def event_error() -> Column:
    m = F.col("event_id") % 7
    return F.when(m == 0, "permanent").when(m.isin(1, 2), "transient").when(m == 3, "retry_after")


@query(f"""with a as (select event_id, {ERROR_SQL} as err, event_id % 11 = 4 as bad, cast(event_id % 5 + 1 as integer) as n from events)
select event_id, case when bad then 'invalid' when err is null then 'ack' when err = 'permanent' then 'invalid' when n >= 4 then 'dead_letter' else 'retry' end as outcome,
       case when not bad and err in ('transient', 'retry_after') and n < 4 then least(20.0, 1.5 * pow(3.0, n - 1)) end as delay from a""")
def settlement_outcome(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events")
    policy = RetryPolicy(Backoff(1.5, 3.0, 20.0), 4, True)
    return settle.settle(df, event_error(), (F.col("event_id") % 5 + 1).cast("int"), policy, F.col("event_id") % 11 == 4).select("event_id", "outcome", "delay")


@query(f"""with a as (select event_id, {ERROR_SQL} as err from events) select case when err is null then 'ack' when err = 'permanent' then 'invalid' else 'retry' end as outcome, count(*) as n from a group by 1""")
def settlement_native_dead_letter(spark: SparkSession, d: str) -> DataFrame:
    """A source that has a dead-letter queue of its own keeps its messages."""
    policy = RetryPolicy(Backoff(1.0), 1, True)
    return settle.settle(read(spark, d, "events"), event_error(), F.lit(9), policy, native_dead_letter=True).groupBy("outcome").agg(F.count("*").alias("n"))


@query("select event_id, cast(event_id % 40 as bigint) as attempt, least(60.0, 0.5 * pow(2.0, event_id % 40)) as capped, case when event_id % 40 < 34 then pow(2.0, event_id % 40) else 1.0 end as free from events")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 40
    return read(spark, d, "events").select("event_id", n.alias("attempt"), Backoff(0.5, 2.0, 60.0).delay(n).alias("capped"), Backoff(1.0).delay(n).alias("free"))


@query("""with a as (select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as rn, case when event_id % 9 = 0 then 100 end as native from events)
select event_id, cast(coalesce(native, rn) as integer) as attempt from a""")
def attempt_count(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events").withColumn("message_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    native = F.when(F.col("event_id") % 9 == 0, F.lit(100))
    return df.select("event_id", settle.attempt_number(native, "message_id", ["ts", "event_id"]).cast("int").alias("attempt"))


@query("""with recursive m as (select event_id, event_id % 6 as fails, case when event_id % 4 = 0 then 90.0 when event_id % 4 = 1 then 0.01 end as wish from events where event_type = 'error'),
a as (
  select event_id, fails, wish, 1 as attempt, 0.0::double as at_s, greatest(0.05, least(coalesce(wish, 0.0), 60.0), 0.1)::double as w from m
  union all
  select event_id, fails, wish, attempt + 1, at_s + w, greatest(0.05 * pow(4.0, attempt), least(coalesce(wish, 0.0), 60.0), 0.1) from a
  where attempt <= fails and attempt < 5 and at_s + w <= 120.0
) select cast(event_id as varchar) as message_id, attempt, at_s as at, case when attempt > fails then 'sent' when attempt >= 5 or at_s + w > 120.0 then 'dead_letter' else 'wait' end as result,
         case when not (attempt > fails) and not (attempt >= 5 or at_s + w > 120.0) then w end as wait from a""")
def producer_retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "events").where("event_type = 'error'").select(
        F.col("event_id").cast("string").alias("message_id"), (F.col("event_id") % 6).cast("int").alias("fails"), F.when(F.col("event_id") % 4 == 0, 90.0).when(F.col("event_id") % 4 == 1, 0.01).alias("wish")
    )
    rows = settle.producer_schedule(m, "fails", "wish", ProducerRetry(Backoff(0.05, 4.0), 5))
    return rows.select("message_id", "attempt", "at", "result", "wait")


@query("select doc_id, strlen(text) > 2000 as too_large from documents")
def payload_too_large(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", settle.payload_too_large(F.col("text"), 2000).alias("too_large"))


@query("select user_id, count(*) as n from events where event_id % 7 in (1, 2, 3) group by 1")
def breaker_health(spark: SparkSession, d: str) -> DataFrame:
    """Only transient errors count against a breaker."""
    df = read(spark, d, "events").where(~settle.healthy(event_error()))
    return df.groupBy("user_id").agg(F.count("*").alias("n"))


@query("select event_id, case when round(value * 1000) > 80000 then 'transient' end as error from events")
def handler_timeout(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", settle.timed_out(F.round(F.col("value") * 1000), 80_000).alias("error"))


@query("""with e as (select event_id, user_id, ts, epoch_us(ts) as t from events),
g as (select *, case when t - lag(t) over (partition by user_id order by t, event_id) >= 7200000000 then 1 else 0 end as fresh from e),
l as (select *, sum(fresh) over (partition by user_id order by t, event_id rows unbounded preceding) as life from g)
select event_id, cast(row_number() over (partition by user_id, life order by t, event_id) as integer) as attempt from l""")
def attempt_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Attempts are forgotten after two idle hours."""
    return settle.attempt_with_ttl(_timed(spark, d), "user_id", "at_us", ["at_us", "event_id"], 7_200_000_000).select("event_id", "attempt")


@query("select event_id, row_number() over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) <= 3 as taken from events")
def poll_clamp(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("poll", F.struct("event_type", F.date_trunc("hour", "ts")))
    return queue.clamp(e, 3, ["ts", "event_id"], "poll").select("event_id", "taken")


@query("""with g as (select event_type, user_id, row_number() over (partition by event_type order by min((ts, event_id)), cast(user_id as varchar)) <= 40 as admitted from events group by event_type, user_id)
select event_id, admitted from events join g using (event_type, user_id)""")
def group_capacity(spark: SparkSession, d: str) -> DataFrame:
    """A store with room for 40 live groups."""
    e = read(spark, d, "events").withColumn("group_key", F.col("user_id").cast("string"))
    return groupstore.admitted(e, "event_type", ["ts", "event_id"], 40).select("event_id", "admitted")


@query("""with g as (select user_id || '/' || event_type as group_key, epoch_us(min(ts)) as created_us from events group by 1), n as (select max(created_us) as now from g)
select group_key, created_us from g where created_us < (select now from n) - 86400000000 order by created_us, group_key limit 100""")
def expired_scan(spark: SparkSession, d: str) -> DataFrame:
    """The 100 oldest groups over the timeout."""
    g = _timed(spark, d).groupBy(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("group_key")).agg(F.min("at_us").alias("created_us"))
    now = g.agg(F.max("created_us")).scalar()
    return groupstore.expired(g, now, 86_400_000_000).select("group_key", "created_us")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows of a queue: some delayed, some leased, some leases over, some headers unreadable."""
    o, now = read(spark, d, "orders"), F.lit(NOW).cast("timestamp_ntz")
    locked = F.col("o_orderkey") % 3 == 0
    minutes = F.col("o_orderkey") % 20
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("msg_id"), F.when(F.col("o_orderkey") % 13 == 0, "{bad").otherwise('{"a":1}').alias("headers"),
        F.when(locked, "w1").alias("locked_by"), F.when(locked, F.timestamp_micros(F.unix_micros(now.cast("timestamp")) - minutes * 60_000_000).cast("timestamp_ntz")).alias("locked_at"),
        F.col("o_orderdate").alias("visible_after"), (F.col("o_orderkey") % 9).cast("int").alias("delivery_count"), (F.col("o_orderkey") % 4).alias("lease_epoch"),
    )


QUEUE_SQL = f"""
with q as (select o_orderkey as id, case when o_orderkey % 13 = 0 then '{{bad' else '{{"a":1}}' end as headers, case when o_orderkey % 3 = 0 then 'w1' end as locked_by,
  case when o_orderkey % 3 = 0 then timestamp '{NOW}' - to_minutes(cast(o_orderkey % 20 as integer)) end as locked_at, o_orderdate as visible_after,
  cast(o_orderkey % 9 as integer) as delivery_count, o_orderkey % 4 as lease_epoch from orders),
c as (select * from q where visible_after <= timestamp '{NOW}' and (locked_at is null or locked_at <= timestamp '{NOW}' - interval 5 minute))
"""


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


@query(QUEUE_SQL + "select id, lease_epoch + 1 as lease_epoch, delivery_count + 1 as delivery_count, 'w2' as locked_by from (select * from c order by visible_after, id limit 100)")
def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    return queue.claim(_queue(spark, d), _now(), 100, "w2").select("id", "lease_epoch", "delivery_count", "locked_by")


@query(QUEUE_SQL + "select id from c where locked_by is not null")
def queue_claim_expired_lease(spark: SparkSession, d: str) -> DataFrame:
    return queue.claimable(_queue(spark, d), _now(), 300_000_000).where("locked_by is not null").select("id")


@query(QUEUE_SQL + f"select id, delivery_count + 1 as delivery_count from q where locked_at is null and visible_after <= timestamp '{NOW}' order by visible_after, id limit 1")
def queue_claim_locked(spark: SparkSession, d: str) -> DataFrame:
    return queue.claim_locked(_queue(spark, d), _now(), "w2").select("id", "delivery_count")


@query(QUEUE_SQL + f"""select id, timestamp '{NOW}' + to_seconds(cast(least(30.0 * pow(2.0, delivery_count), 3600.0) as bigint)) as visible_after from c where headers = '{{bad'""")
def corrupt_row_penalty(spark: SparkSession, d: str) -> DataFrame:
    # all that could be claimed, as it is after a claim; no order, no limit
    claimed = queue.claimable(_queue(spark, d), _now(), 300_000_000).withColumn("delivery_count", F.col("delivery_count") + 1)
    return queue.corrupt(claimed, _now())[1].select("id", F.col("visible_after").cast("timestamp_ntz").alias("visible_after"))


@query(QUEUE_SQL + f"""select id, case when locked_by is null or id % 6 = 0 then 'stale' when id % 4 = 1 then 'deleted' else 'requeued' end as result,
  case when locked_by is not null and id % 6 <> 0 and id % 4 <> 1 then timestamp '{NOW}' + to_seconds(id % 50) end as visible_after from q""")
def fenced_settle(spark: SparkSession, d: str) -> DataFrame:
    """Settlements apply only with the holder and epoch of the lease."""
    q = _queue(spark, d)
    events = q.select("id", F.lit("w1").alias("locked_by"), F.when(F.col("id") % 6 == 0, F.col("lease_epoch") + 1).otherwise(F.col("lease_epoch")).alias("lease_epoch"), F.when(F.col("id") % 4 == 1, "ack").otherwise("nack").alias("action"), (F.col("id") % 50 * 1_000_000).alias("delay_us"), _now().alias("at"))
    return queue.settle(q, events).select("id", "result", F.col("visible_after").cast("timestamp_ntz").alias("visible_after"))


@query("select event_id, ts + to_milliseconds(greatest(event_id % 100 - 20, 0)) as visible_after from events")
def scheduled_visibility(spark: SparkSession, d: str) -> DataFrame:
    later = queue.visible_after(F.col("ts"), (F.col("event_id") % 100 - 20) * 1000)
    return read(spark, d, "events").select("event_id", later.cast("timestamp_ntz").alias("visible_after"))


@query("""select user_id || '/' || event_type as message_id, arg_min(event_id, (ts, event_id)) as event_id from events where user_id % 4 > 0 group by 1""")
def dedup_inbox(spark: SparkSession, d: str) -> DataFrame:
    """The first of each id that the inbox hasn't seen."""
    e = read(spark, d, "events").withColumn("message_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    inbox = e.where("user_id % 4 = 0").select(F.col("message_id").alias("msg_id")).distinct()
    return queue.unprocessed(e, inbox, ["ts", "event_id"]).select("message_id", "event_id")


@query("with n as (select max(ts) as now from events) select event_id from events where not ts < (select now from n) - interval 10 day")
def inbox_purge(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    now = e.agg(F.max("ts")).scalar()
    return queue.purge(e, now, 10 * 86_400_000_000, "ts").select("event_id")


OVERFLOW = "select event_id, case when row_number() over (partition by user_id order by ts{0}, event_id{0}) <= 20 then 'accepted' else '{1}' end as status from events"


def _overflow(spark: SparkSession, d: str, policy: str) -> DataFrame:
    return queue.overflow(read(spark, d, "events"), 20, policy, ["ts", "event_id"], "user_id").select("event_id", "status")


@query(OVERFLOW.format("", "dropped"))
def overflow_drop_newest(spark: SparkSession, d: str) -> DataFrame:
    return _overflow(spark, d, "drop_newest")


@query(OVERFLOW.format(" desc", "dropped"))
def overflow_drop_oldest(spark: SparkSession, d: str) -> DataFrame:
    return _overflow(spark, d, "drop_oldest")


@query(OVERFLOW.format("", "rejected"))
def overflow_reject(spark: SparkSession, d: str) -> DataFrame:
    return _overflow(spark, d, "reject")


@query(OVERFLOW.format("", "blocked"))
def overflow_block(spark: SparkSession, d: str) -> DataFrame:
    return _overflow(spark, d, "block")


BOUNDED = """
with recursive o as (select user_id, event_id, event_type = 'view' as settle, row_number() over (partition by user_id order by ts, event_id) as rn from events),
f as (
  select user_id, event_id, rn, case when settle then [] else [event_id] end as held, case when settle then 'unknown' else 'accepted' end as status from o where rn = 1
  union all
  select o.user_id, o.event_id, o.rn,
    case when o.settle then list_slice(f.held, 2, len(f.held)) when len(f.held) < 3 then list_append(f.held, o.event_id) {full_held} end,
    case when o.settle then case when len(f.held) > 0 then 'settled' else 'unknown' end when len(f.held) < 3 then 'accepted' else '{full}' end
  from f join o on o.user_id = f.user_id and o.rn = f.rn + 1
) select event_id, status, cast(len(held) as bigint) as depth from f"""


def _bounded(spark: SparkSession, d: str, policy: str) -> DataFrame:
    """Views settle the oldest message that a queue of three holds, all others are offers. What a settlement
    names depends on the policy, so the log says only that it is one of the head."""
    e = read(spark, d, "events")
    log = e.withColumn("command", F.when(F.col("event_type") == "view", "head").otherwise("offer")).withColumn("id", F.col("event_id"))
    return queue.bounded_queue(log, 3, policy, ["ts", "event_id"], "user_id").select("event_id", "status", "depth")


@query(BOUNDED.format(full="dropped", full_held="else f.held"))
def overflow_with_settlements(spark: SparkSession, d: str) -> DataFrame:
    """Settlements free the queue."""
    return _bounded(spark, d, "drop_newest")


@query(BOUNDED.format(full="evicting", full_held="else list_append(list_slice(f.held, 2, 3), o.event_id)"))
def overflow_evicting(spark: SparkSession, d: str) -> DataFrame:
    """A full queue loses its head to a new message."""
    return _bounded(spark, d, "drop_oldest")


@query("select event_id, case when event_id % 4 > 0 then least(30000000, 1000000 * pow(2, event_id % 4 - 1)) when event_id % 3 > 0 then 0 else 1000000 end::bigint as wait_us from events")
def poll_backoff(spark: SparkSession, d: str) -> DataFrame:
    """How long a poll loop waits: not at all, an interval, or longer after each error."""
    state = read(spark, d, "events").select("event_id", (F.col("event_id") % 4).alias("failures"), (F.col("event_id") % 3).alias("n"))
    return queue.next_poll(state).select("event_id", "wait_us")


@query("""with recursive o as (select event_type as store, event_id, user_id as k, user_id % 4 = 0 and event_id % 2 = 0 as settle, row_number() over (partition by event_type order by ts, event_id) as rn from events),
f as (
  select store, event_id, rn, case when settle then [] else [k] end as live, not settle as admitted from o where rn = 1
  union all
  select o.store, o.event_id, o.rn,
    case when o.settle then list_filter(f.live, lambda x: x <> o.k) when list_contains(f.live, o.k) then f.live when len(f.live) < 40 then list_append(f.live, o.k) else f.live end,
    case when o.settle then list_contains(f.live, o.k) else list_contains(f.live, o.k) or len(f.live) < 40 end
  from f join o on o.store = f.store and o.rn = f.rn + 1
) select event_id, admitted from f""")
def group_capacity_freed(spark: SparkSession, d: str) -> DataFrame:
    """A settled group leaves room for another one."""
    command = F.when((F.col("user_id") % 4 == 0) & (F.col("event_id") % 2 == 0), "settle").otherwise("add")
    log = read(spark, d, "events").withColumn("group_key", F.col("user_id").cast("string")).withColumn("command", command)
    return groupstore.bounded_store(log, "event_type", ["ts", "event_id"], 40).select("event_id", "admitted")


@query("""with recursive o as (select user_id, event_id, epoch_us(ts) as t, 1 + (event_id % 500) * 600000000 as took, row_number() over (partition by user_id order by ts, event_id) as rn from events),
f as (
  select user_id, event_id, rn, t as start_us, [t + took] as ends from o where rn = 1
  union all
  select o.user_id, o.event_id, o.rn, case when len(f.ends) < 2 then o.t else greatest(o.t, list_min(f.ends)) end,
    list_append(case when len(f.ends) < 2 then f.ends else list_slice(list_sort(f.ends), 2, 2) end, (case when len(f.ends) < 2 then o.t else greatest(o.t, list_min(f.ends)) end) + o.took)
  from f join o on o.user_id = f.user_id and o.rn = f.rn + 1
) select event_id, start_us from f""")
def credit_gate(spark: SparkSession, d: str) -> DataFrame:
    """Two messages of a user in flight at once; the next one waits for a credit."""
    df = _timed(spark, d).withColumn("end_us", F.col("at_us") + 1 + (F.col("event_id") % 500) * 600_000_000)
    return flowctl.credit_gate(df, "user_id", "at_us", "end_us", ["at_us", "event_id"], 2).select("event_id", "start_us")


@query("""select cast(event_id as varchar) as msg_id, '{"k":' || event_id % 7 || '}' as headers, event_type as payload, ts + to_milliseconds(greatest(event_id % 100 - 20, 0)) as visible_after,
  cast(0 as integer) as delivery_count, 0::bigint as lease_epoch, true as unlocked, ts as created_at from events""")
def scheduled_insert(spark: SparkSession, d: str) -> DataFrame:
    """What a delayed send inserts in a queue table."""
    e = read(spark, d, "events").withColumn("message_id", F.col("event_id").cast("string"))
    headers = F.concat(F.lit('{"k":'), (F.col("event_id") % 7).cast("string"), F.lit("}"))
    rows = queue.scheduled(e, F.col("ts"), (F.col("event_id") % 100 - 20) * 1000, headers, F.col("event_type"))
    time = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return rows.select("msg_id", "headers", F.col("payload").cast("string").alias("payload"), time("visible_after"), "delivery_count", "lease_epoch", F.col("locked_by").isNull().alias("unlocked"), time("created_at"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("""with a as (select event_id, event_type, epoch_us(ts) as t, row_number() over (partition by event_type order by ts, event_id) - 1 as i from events),
b as (select *, max(t - i * 900000000) over (partition by event_type order by i rows between unbounded preceding and 1 preceding) as m from a)
select event_id, cast(greatest(t, coalesce(m + (i - 2) * 900000000, t)) as bigint) as release_us from b""")
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """A token every 15 minutes, three at once."""
    return flowctl.token_bucket(_timed(spark, d), "event_type", "at_us", ["at_us", "event_id"], 1 / 900, 3).select("event_id", "release_us")


@query("""
with recursive o as (select user_id, event_id, epoch_us(ts) as t, event_id % 5 < 2 as ok, row_number() over (partition by user_id order by ts, event_id) as rn from events),
f as (
  select user_id, event_id, rn, t, true as admitted, case when ok then 'closed' else 'closed' end as state, case when ok then 0 else 1 end as fails, 0::bigint as since from o where rn = 1
  union all
  select o.user_id, o.event_id, o.rn, o.t, not (f.state = 'open' and o.t - f.since < 7200000000),
    case when f.state = 'open' and o.t - f.since < 7200000000 then 'open' when o.ok then 'closed' when f.state = 'open' or f.fails + 1 >= 3 then 'open' else 'closed' end,
    case when f.state = 'open' and o.t - f.since < 7200000000 then f.fails when o.ok then 0 when f.state = 'open' then 3 else f.fails + 1 end,
    case when f.state = 'open' and o.t - f.since < 7200000000 then f.since when not o.ok and (f.state = 'open' or f.fails + 1 >= 3) then o.t else f.since end
  from f join o on o.user_id = f.user_id and o.rn = f.rn + 1
) select event_id, admitted, state from f""")
def breaker_trip(spark: SparkSession, d: str) -> DataFrame:
    df = _timed(spark, d).select("user_id", "event_id", "at_us", (F.col("event_id") % 5 < 2).alias("ok"))
    return flowctl.breaker(df, "user_id", "at_us", ["at_us", "event_id"], "ok", 3, 7_200_000_000).select("event_id", "admitted", "state")


@query("""with o as (select user_id, event_id, ts, event_id % 5 < 2 as ok, sum(cast(event_id % 5 < 2 as integer)) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from events)
select event_id, cast(sum(cast(not ok as integer)) over (partition by user_id, g order by ts, event_id rows unbounded preceding) as bigint) as run from o""")
def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events").withColumn("ok", F.col("event_id") % 5 < 2)
    return flowctl.failure_runs(df, "user_id", ["ts", "event_id"], "ok").select("event_id", "run")


@query("""with e as (select event_type, event_id, unnest([epoch_us(ts), epoch_us(ts) + 1 + (event_id % 500) * 60000000]) as at_us, unnest([1, -1]) as d from events),
r as (select event_id, d, sum(d) over (partition by event_type order by at_us, d, event_id rows unbounded preceding) as n from e)
select event_id, cast(n as bigint) as in_flight from r where d = 1""")
def credit_inflight(spark: SparkSession, d: str) -> DataFrame:
    df = _timed(spark, d).withColumn("end_us", F.col("at_us") + 1 + (F.col("event_id") % 500) * 60_000_000)
    return flowctl.in_flight(df, "event_type", "at_us", "end_us", "event_id").select("event_id", "in_flight")
