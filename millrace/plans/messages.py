"""Queries of the envelope, flow, expression, aggregation, publish-subscribe and exchange operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import envelope
from millrace.functions import exprs, http
from millrace.operators import aggregate, exchange, flow

from .base import query, read
from .flagship import ORDER_SQL, order_messages

K = "cast(json_extract_string(props, '$.k') as bigint)"
CENTS_SQL = "cast(round(value * 100, 0) as bigint)"


def _flat(df: DataFrame) -> DataFrame:
    return df.select("message_id", F.col("payload.type").alias("type"), F.col("payload.value").alias("value"))


EVENT = "select cast(event_id as varchar) as message_id, event_type as type, value from events"


@query(EVENT + " where event_type = 'purchase' and value > 50")
def filter_pass(spark: SparkSession, d: str) -> DataFrame:
    return _flat(flow.filter_((F.col("payload.type") == "purchase") & (F.col("payload.value") > 50))(envelope.events(spark, d)))


@query(EVENT + " where not coalesce(event_type = 'purchase' and value > 50, false)")
def filter_discard(spark: SparkSession, d: str) -> DataFrame:
    step = flow.filter_((F.col("payload.type") == "purchase") & (F.col("payload.value") > 50), "discarded")
    return _flat(step(envelope.events(spark, d)).sides["discarded"])


@query(EVENT.replace(" from", f", {K} as k from") + f" where {K} > 3 and event_type = 'click'")
def filter_expr(spark: SparkSession, d: str) -> DataFrame:
    passed, _, _ = exprs.filter_expr(envelope.events(spark, d), 'header("k") > 3 && payload.type == "click"')
    return passed.select("message_id", F.col("payload.type").alias("type"), F.col("payload.value").alias("value"), envelope.header_int(F.col("headers"), "k").alias("k"))


@query("select cast(event_id as varchar) as message_id from events where event_type = 'click'")
def filter_expr_missing_header(spark: SparkSession, d: str) -> DataFrame:
    """Comparing a header that isn't there is an error of the message; equality would be false."""
    _, _, failed = exprs.filter_expr(envelope.events(spark, d), 'payload.type == "click" && header("absent") > 3')
    return failed.select("message_id")


@query("select event_type as type, count(*) as n from events where event_id % 3 = 0 group by 1")
def expr_arithmetic_error(spark: SparkSession, d: str) -> DataFrame:
    """A remainder by zero is an error of its message; a division by zero is infinite."""
    df = envelope.events(spark, d).withColumn("payload", F.struct("payload.type", (F.col("message_id").cast("bigint") % 3).alias("n")))
    _, _, failed = exprs.filter_expr(df, "1 / payload.n < 100000 && 7 % payload.n >= 0 || 7 % payload.n >= 0")
    return failed.groupBy(F.col("payload.type").alias("type")).agg(F.count("*").alias("n"))


@query("select cast(event_id as varchar) as message_id, event_id % 4 > 1 as passed, event_id % 4 < 2 as failed from events")
def expr_index_error(spark: SparkSession, d: str) -> DataFrame:
    """An index out of range is an error, not a rejection."""
    df = envelope.events(spark, d)
    df = df.withColumn("payload", F.struct(F.slice(F.array(*map(F.lit, range(4))), 1, (F.col("message_id").cast("bigint") % 4).cast("int")).alias("items")))
    e = exprs.compile_expression("payload.items[1] >= 0 && payload.items[-2] >= 0", df, "boolean")
    return df.select("message_id", F.coalesce(e.value, F.lit(False)).alias("passed"), e.err.alias("failed"))


@query(f"select case when event_id % 2 = 0 then case when {K} > 5 then 'high' else 'low' end end as channel, event_id % 2 = 1 as err, count(*) as n from events group by all")
def route_expr_error(spark: SparkSession, d: str) -> DataFrame:
    """A key that fails is no route, not the default one."""
    df = envelope.events(spark, d)
    key = F.when(F.col("message_id").cast("bigint") % 2 == 0, F.col("headers")).otherwise(F.expr("cast(map() as map<string,string>)"))
    routed = exprs.route_expr(df.withColumn("headers", key), 'header("k") > 5 ? "up" : "down"', {"up": "high"}, "low")
    return routed.groupBy("channel", "err").agg(F.count("*").alias("n"))


@query("""select 'o-' || o_orderkey as message_id, 'split' as kind, count(*) as n from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 3 > 0 group by 1
union all select 'o-' || o_orderkey, 'failed', 1 from orders where o_orderkey % 3 = 0 and o_orderkey in (select l_orderkey from lineitem)""")
def split_expr_error(spark: SparkSession, d: str) -> DataFrame:
    """A message that can't be split gives no children and is an error."""
    df = order_messages(spark, d).withColumn("payload", F.struct(F.col("payload").alias("lines"), (F.regexp_extract("message_id", r"\d+", 0).cast("bigint") % 3).alias("n")))
    text = "7 % payload.n >= 0 ? payload.lines : payload.lines"
    children = exprs.split_expr(df, text).groupBy(F.col("correlation_id").alias("message_id")).agg(F.lit("split").alias("kind"), F.count("*").alias("n"))
    failed = exprs.split_expr_failed(df, text).select("message_id", F.lit("failed").alias("kind"), F.lit(1).cast("bigint").alias("n"))
    return children.unionByName(failed)


@query("select cast(event_id as varchar) as message_id, value * 2 as payload, cast(user_id as varchar) as correlation_id from events")
def transform(spark: SparkSession, d: str) -> DataFrame:
    return flow.transform(F.col("payload.value") * 2)(envelope.events(spark, d)).select("message_id", "payload", "correlation_id")


@query("select cast(event_id as varchar) as message_id, case when value > 50 then event_type || '!' else 'low' end as payload from events")
def transform_expr(spark: SparkSession, d: str) -> DataFrame:
    return exprs.transform_expr(envelope.events(spark, d), 'payload.value > 50 ? payload.type + "!" : "low"', "string").select("message_id", "payload")


ROUTES = {"purchase": "billing", "signup": "accounts", "error": "alerts"}


@query("""select case event_type when 'purchase' then 'billing' when 'signup' then 'accounts' when 'error' then 'alerts' end as channel,
    count(*) as n from events where event_type in ('purchase', 'signup', 'error') group by 1""")
def router(spark: SparkSession, d: str) -> DataFrame:
    routed = flow.route(F.col("payload.type"), ROUTES)(envelope.events(spark, d))
    return routed.where(F.col("channel").isNotNull()).groupBy("channel").agg(F.count("*").alias("n"))


@query("select event_type as type, count(*) as n from events where event_type not in ('purchase', 'signup', 'error') group by 1")
def router_unrouted(spark: SparkSession, d: str) -> DataFrame:
    routed = flow.unrouted(flow.route(F.col("payload.type"), ROUTES)(envelope.events(spark, d)))
    return routed.groupBy(F.col("payload.type").alias("type")).agg(F.count("*").alias("n"))


@query("""select case event_type when 'purchase' then 'billing' when 'signup' then 'accounts' when 'error' then 'alerts' else 'other' end as channel,
    count(*) as n from events group by 1""")
def router_default(spark: SparkSession, d: str) -> DataFrame:
    return flow.route(F.col("payload.type"), ROUTES, "other")(envelope.events(spark, d)).groupBy("channel").agg(F.count("*").alias("n"))


@query(f"select case when {K} > 5 then 'high' else 'low' end as channel, count(*) as n from events group by 1")
def router_expr(spark: SparkSession, d: str) -> DataFrame:
    routed = exprs.route_expr(envelope.events(spark, d), 'header("k") > 5 ? "up" : "down"', {"up": "high"}, "low")
    return routed.groupBy("channel").agg(F.count("*").alias("n"))


@query(ORDER_SQL.replace(" where o_orderstatus = 'F'", "") + """
select 'o-' || l_orderkey || '#' || n as message_id, 'o-' || l_orderkey as correlation_id, cast(n as integer) as sequence_number,
       cast(total as integer) as sequence_size, l_partkey as part from line""")
def split_stamp(spark: SparkSession, d: str) -> DataFrame:
    children = flow.split(F.col("payload"))(order_messages(spark, d))
    return children.select("message_id", "correlation_id", "sequence_number", "sequence_size", F.col("payload.l_partkey").alias("part"))


@query(ORDER_SQL.replace(" where o_orderstatus = 'F'", "") + """, big as (
  select *, row_number() over (partition by l_orderkey order by n) as m from line where l_quantity > 25)
select 'o-' || l_orderkey || '#' || m as message_id, l_quantity as quantity from big""")
def split_expr(spark: SparkSession, d: str) -> DataFrame:
    children = exprs.split_expr(order_messages(spark, d), "filter(payload, {.l_quantity > 25})")
    return children.select("message_id", F.col("payload.l_quantity").alias("quantity"))


BATCHED = f"""
with placed as (select user_id, {CENTS_SQL} as cents, (row_number() over (partition by user_id order by ts, event_id) - 1) // 5 as batch from events),
done as (select cast(user_id as varchar) as group_key, cast(batch as bigint) as batch, count(*) as n_members, cast(sum(cents) as bigint) as cents from placed group by all)
"""


def _batches(spark: SparkSession, d: str) -> DataFrame:
    msgs = envelope.events(spark, d).withColumn("event_id", F.col("message_id").cast("bigint"))
    good, _ = aggregate.correlated(msgs, F.col("correlation_id"))
    return aggregate.by_completion_size(good, 5, ["ts", "event_id"], {"cents": F.sum(F.round(F.col("payload.value") * 100, 0).cast("bigint"))})


@query(BATCHED + "select group_key, batch, n_members, cents from done where n_members >= 5")
def agg_completion_size(spark: SparkSession, d: str) -> DataFrame:
    return _batches(spark, d).where("released").drop("released")


@query(BATCHED + "select group_key, batch, n_members, cents from done where n_members < 5")
def agg_residual_held(spark: SparkSession, d: str) -> DataFrame:
    return _batches(spark, d).where("not released").drop("released")


SIZED = """
with recursive o as (select conv_id, turn, length(text) as chars, {size} as size, row_number() over (partition by conv_id order by turn, length(text), text) as rn from conversations),
f as (
  select conv_id, rn, chars, 0 as batch, 1 as n, size as expected, coalesce(1 >= size, false) as done from o where rn = 1
  union all
  select o.conv_id, o.rn, o.chars, f.batch + cast(f.done as integer), case when f.done then 1 else f.n + 1 end, case when f.done then o.size else f.expected end,
         case when f.done then coalesce(1 >= o.size, false) else coalesce(f.n + 1 >= f.expected, false) end
  from f join o on o.conv_id = f.conv_id and o.rn = f.rn + 1
), g as (select cast(conv_id as varchar) as group_key, cast(batch as bigint) as batch, count(*) as n_members, cast(max(expected) as bigint) as expected, bool_or(done) as released, cast(sum(chars) as bigint) as chars from f group by conv_id, batch)
"""


def _sized(spark: SparkSession, d: str, size: Column) -> DataFrame:
    df = read(spark, d, "conversations").withColumn("chars", F.char_length("text").cast("bigint"))
    good, _ = aggregate.correlated(df.withColumn("sequence_size", size), F.col("conv_id"))
    return aggregate.by_sequence_size(good, ["turn", "chars", "text"], {"chars": F.sum("chars")})


@query(SIZED.format(size="length(text) % 7 + 1") + "select * from g")
def agg_sequence_size(spark: SparkSession, d: str) -> DataFrame:
    """A group is as large as its first member says and then begins anew."""
    return _sized(spark, d, (F.char_length("text") % 7 + 1).cast("bigint"))


@query(SIZED.format(size="case when length(text) % 5 > 0 then length(text) % 3 end") + "select group_key, batch, n_members, expected, chars from g where not released")
def agg_sequence_residual(spark: SparkSession, d: str) -> DataFrame:
    """What is held: the rest after the last release, and groups whose first member has no size."""
    size = F.when(F.char_length("text") % 5 > 0, (F.char_length("text") % 3).cast("bigint"))
    return _sized(spark, d, size).where("not released").drop("released")


@query("""with k as (select *, case when value > 20 then event_type else '' end as group_key from events)
select group_key, count(*) as n, 'good' as kind from k where group_key <> '' and value <= 90 group by 1
union all select '', count(*), 'missing' from k where group_key = '' and value <= 90 union all select '', count(*), 'failed' from k where value > 90""")
def agg_correlation_expr(spark: SparkSession, d: str) -> DataFrame:
    """A group key by expression: an empty one is invalid for good, an error is of its message."""
    text = '(payload.value > 90 ? header("absent") > 1 : true) && payload.value > 20 ? payload.type : ""'
    good, missing, failed = aggregate.correlated_expr(envelope.events(spark, d), text)
    count = lambda df, kind: df.groupBy().agg(F.lit("").alias("group_key"), F.count("*").alias("n"), F.lit(kind).alias("kind"))
    found = good.groupBy("group_key").agg(F.count("*").alias("n"), F.lit("good").alias("kind"))
    return found.unionByName(count(missing, "missing")).unionByName(count(failed, "failed"))


FOLD = """
with recursive o as (select user_id, event_id, {value} as v, {at} as at_us, row_number() over (partition by user_id order by ts, event_id) as rn from events),
"""


@query(FOLD.format(value="value", at="0") + """
f as (
  select user_id, event_id, rn, 0 as batch, 1 as place, v as total, 1 >= 2 and v >= 120 as done from o where rn = 1
  union all
  select o.user_id, o.event_id, o.rn, f.batch + cast(f.done as integer), case when f.done then 1 else f.place + 1 end,
         case when f.done then o.v else f.total + o.v end,
         case when f.done then false else f.place + 1 >= 2 and f.total + o.v >= 120 end
  from f join o on o.user_id = f.user_id and o.rn = f.rn + 1
) select event_id, cast(batch as bigint) as batch, cast(place as bigint) as place from f""")
def agg_release_rule(spark: SparkSession, d: str) -> DataFrame:
    """Released as soon as two members or more add up to 120, again and again."""
    df = read(spark, d, "events").withColumn("group_key", F.col("user_id").cast("string")).select("group_key", "event_id", "ts", "value")
    return aggregate.until(df, ["ts", "event_id"], "value", 120.0, 2).select("event_id", "batch", "place")


@query(FOLD.format(value="value", at="event_id % 10") + """
f as (
  select user_id, event_id, rn, 0 as batch, 1 as place, v as top, coalesce(at_us < 9 and (v > 80 or 1 >= 4), false) as done, at_us >= 9 as err from o where rn = 1
  union all
  select o.user_id, o.event_id, o.rn, f.batch + cast(f.done as integer), case when f.done then 1 else f.place + 1 end, case when f.done then o.v else greatest(f.top, o.v) end,
         o.at_us < 9 and ((case when f.done then o.v else greatest(f.top, o.v) end) > 80 or (case when f.done then 1 else f.place + 1 end) >= 4), o.at_us >= 9
  from f join o on o.user_id = f.user_id and o.rn = f.rn + 1
) select event_id, cast(batch as bigint) as batch, cast(place as bigint) as place, done as complete, err from f""")
def agg_release_expr(spark: SparkSession, d: str) -> DataFrame:
    """Released by an expression over the live members, again and again; it fails where the newest has no number."""
    df = read(spark, d, "events").withColumns({"group_key": F.col("user_id").cast("string"), "payload": F.struct("value"), "sequence_size": F.lit(None).cast("int")})
    digit = (F.col("event_id") % 10).cast("string")
    df = df.withColumn("headers", F.create_map(F.lit("d"), F.when(F.col("event_id") % 10 < 9, digit).otherwise(F.lit('"none"'))))
    text = 'messages[-1].header("d") >= 0 && (any(messages, {.payload.value > 80}) || len(messages) >= 4)'
    return aggregate.by_release_expr(df, ["ts", "event_id"], text).select("event_id", "batch", "place", "complete", "err")


@query("""with g as (select user_id, event_type, count(*) as n, min(ts) as created_at from events group by all), n as (select max(ts) as now from events)
select event_id, event_type as type from events join g using (user_id, event_type), n where g.n < 12 and created_at < now - interval 1 hour - interval 20 day""")
def agg_expired_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of expired groups, one by one."""
    df = read(spark, d, "events").withColumn("type", F.col("event_type")).withColumn("group_key", F.col("user_id").cast("string"))
    return aggregate.expired_members(df, _reaped(df), ["group_key", "type"]).select("event_id", "type")


@query(FOLD.format(value="0", at="epoch_us(ts)") + """
f as (
  select user_id, event_id, rn, 0 as generation, 1 as place, at_us as start_us from o where rn = 1
  union all
  select o.user_id, o.event_id, o.rn, f.generation + case when f.place >= 4 or o.at_us > f.start_us + 3600000000 then 1 else 0 end,
         case when f.place >= 4 or o.at_us > f.start_us + 3600000000 then 1 else f.place + 1 end,
         case when f.place >= 4 or o.at_us > f.start_us + 3600000000 then o.at_us else f.start_us end
  from f join o on o.user_id = f.user_id and o.rn = f.rn + 1
) select event_id, cast(generation as bigint) as generation, cast(place as bigint) as place from f""")
def agg_timeout_generations(spark: SparkSession, d: str) -> DataFrame:
    """Expiry seen at the next arrival: an hour after a generation's first member, or after four."""
    df = read(spark, d, "events").select(F.col("user_id").cast("string").alias("group_key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return aggregate.with_timeout(df, "at_us", 3_600_000_000, 4, ["at_us", "event_id"]).select("event_id", "generation", "place")


@query("""with g as (select cast(user_id as varchar) as group_key, event_type as type, count(*) as n_members, min(ts) as created_at from events group by all),
  n as (select max(ts) - interval 1 hour as as_of from events)
  select group_key, type, n_members, case when n_members >= 12 then 'output' when created_at < (select as_of from n) - interval 20 day then 'expired' else 'held' end as fate from g""")
def agg_group_timeout(spark: SparkSession, d: str) -> DataFrame:
    """One pass of the reaper at a given time."""
    df = read(spark, d, "events").withColumn("type", F.col("event_type")).withColumn("group_key", F.col("user_id").cast("string"))
    return _reaped(df).select("group_key", "type", "n_members", "fate")


def _reaped(df: DataFrame) -> DataFrame:
    """Groups by key and type as the reaper finds them an hour before the last event; its time is a scalar of the same plan."""
    as_of = df.agg((F.max("ts") - F.expr("interval 1 hour")).alias("as_of")).scalar()
    groups = df.groupBy("group_key", "type").agg(F.count("*").alias("n_members"), F.min("ts").alias("created_at")).withColumn("released", F.col("n_members") >= 12)
    return aggregate.reap(groups, as_of, 20 * 86_400_000_000)


@query("select cast(event_id as varchar) as message_id from events where user_id % 10 = 3")
def missing_correlation_invalid(spark: SparkSession, d: str) -> DataFrame:
    """Messages without a correlation id are invalid for good."""
    msgs = envelope.events(spark, d).withColumn("correlation_id", F.when(F.col("correlation_id").cast("bigint") % 10 != 3, F.col("correlation_id")))
    return aggregate.correlated(msgs, F.col("correlation_id"))[1].select("message_id")


@query("""select cast(user_id as varchar) as group_key, count(distinct event_type) as n_members from events group by 1""")
def agg_idempotent_add(spark: SparkSession, d: str) -> DataFrame:
    """A repeated id in a group changes nothing; here the type stands for the id."""
    df = read(spark, d, "events").withColumn("group_key", F.col("user_id").cast("string")).withColumn("message_id", F.col("event_type"))
    return aggregate.once(df, ["ts", "event_id"]).groupBy("group_key").agg(F.count("*").alias("n_members"))


def _topics() -> flow.Topics:
    topics = flow.Topics()
    for topic, name in (("click", "stats"), ("purchase", "stats"), ("purchase", "billing"), ("purchase", "mail"), ("signup", "mail"), ("view", "gone")):
        n = topics.subscribe(topic, name)
    topics.cancel("view", n)
    return topics


SUBSCRIBED = """
with s(topic, subscriber) as (values ('click', 'stats'), ('purchase', 'stats'), ('purchase', 'billing'), ('purchase', 'mail'), ('signup', 'mail')),
t as (select event_id, subscriber, value from events join s on topic = event_type)
"""


@query(SUBSCRIBED + "select cast(event_id as varchar) as message_id, subscriber from t")
def pubsub_topic(spark: SparkSession, d: str) -> DataFrame:
    return _topics().publish(envelope.events(spark, d), F.col("payload.type")).select("message_id", "subscriber")


def _delivered(spark: SparkSession, d: str, best_effort: bool) -> DataFrame:
    rows = _topics().publish(envelope.events(spark, d), F.col("payload.type"))
    return flow.fan_out_outcome(rows, ~((F.col("subscriber") == "billing") & (F.col("payload.value") > 60)), best_effort)


OUTCOME = """select cast(event_id as varchar) as message_id, count(*) as n_subscribers,
  cast(sum(case when subscriber = 'billing' and value > 60 then 1 else 0 end) as bigint) as n_failed, """


@query(SUBSCRIBED + OUTCOME + "case when n_failed = 0 then 'ack' else 'retry' end as outcome from t group by event_id")
def pubsub_all_succeed(spark: SparkSession, d: str) -> DataFrame:
    return _delivered(spark, d, False)


@query(SUBSCRIBED + OUTCOME + "'ack' as outcome from t group by event_id")
def pubsub_best_effort(spark: SparkSession, d: str) -> DataFrame:
    return _delivered(spark, d, True)


EXCHANGE = """
with q as (select event_id as request_id, 'r-' || event_id as correlation_id, ts as sent_at from events where event_type = 'view'),
p as (select event_id as reply_id, 'r-' || (event_id - event_id % 7) as correlation_id, ts + interval (cast(value as bigint)) second as replied_at from events where event_type <> 'view'),
m as (select request_id, min((replied_at, reply_id)) as f from q join p on q.correlation_id = p.correlation_id and replied_at between sent_at and sent_at + interval 30 day group by 1)
"""


def _exchange(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, d, "events")
    key = lambda c: F.concat(F.lit("r-"), c.cast("string"))
    requests = e.where("event_type = 'view'").select(F.col("event_id").alias("request_id"), key(F.col("event_id")).alias("correlation_id"), F.col("ts").alias("sent_at"))
    # rint: as the cast of the SQL, halves go to the even second
    later = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.rint("value").cast("bigint") * 1_000_000).cast("timestamp_ntz")
    replies = e.where("event_type <> 'view'").select(F.col("event_id").alias("reply_id"), key(F.col("event_id") - F.col("event_id") % 7).alias("correlation_id"), later.alias("replied_at"))
    return requests, replies


@query(EXCHANGE + "select q.request_id, f[2] as reply_id, case when f is null then 'timeout' else 'replied' end as result from q left join m on m.request_id = q.request_id")
def request_reply(spark: SparkSession, d: str) -> DataFrame:
    return exchange.correlate(*_exchange(spark, d), 30 * 86_400_000_000).select("request_id", "reply_id", "result")


@query(EXCHANGE + "select reply_id from p where reply_id not in (select f[2] from m)")
def reply_unmatched(spark: SparkSession, d: str) -> DataFrame:
    requests, replies = _exchange(spark, d)
    return exchange.unmatched(replies, exchange.correlate(requests, replies, 30 * 86_400_000_000)).select("reply_id")


REUSED = """
with recursive e as (select event_id, user_id % 60 as c, epoch_us(ts) as t, event_type in ('view', 'click') as ask from events),
o as (select *, row_number() over (partition by c order by t, not ask, event_id) as rn from e),
f as (
  select c, rn, event_id, ask, case when ask then event_id end as open, case when ask then t + 3600000000 end as until_us, case when ask then 'accepted' else 'unmatched' end as fate, cast(null as bigint) as of_request from o where rn = 1
  union all
  select o.c, o.rn, o.event_id, o.ask,
    case when o.ask then case when f.open is not null and o.t <= f.until_us then f.open else o.event_id end when f.open is not null and o.t <= f.until_us then null else f.open end,
    case when o.ask then case when f.open is not null and o.t <= f.until_us then f.until_us else o.t + 3600000000 end when f.open is not null and o.t <= f.until_us then null else f.until_us end,
    case when o.ask then case when f.open is not null and o.t <= f.until_us then 'duplicate' else 'accepted' end when f.open is not null and o.t <= f.until_us then 'matched' else 'unmatched' end,
    case when not o.ask and f.open is not null and o.t <= f.until_us then f.open end
  from f join o on o.c = f.c and o.rn = f.rn + 1
), m as (select of_request, min(event_id) as reply_id from f where of_request is not null group by 1)
"""


def _reused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Views and clicks ask, the others reply, with 60 correlation ids in all."""
    e = read(spark, d, "events").withColumn("correlation_id", (F.col("user_id") % 60).cast("string"))
    ask = F.col("event_type").isin("view", "click")
    requests = e.where(ask).select(F.col("event_id").alias("request_id"), "correlation_id", F.col("ts").alias("sent_at"))
    return requests, e.where(~ask).select(F.col("event_id").alias("reply_id"), "correlation_id", F.col("ts").alias("replied_at"))


@query(REUSED + "select event_id as request_id, reply_id, case when fate = 'duplicate' then 'duplicate' when reply_id is null then 'timeout' else 'replied' end as result from f left join m on m.of_request = event_id where ask")
def request_reply_reuse(spark: SparkSession, d: str) -> DataFrame:
    """A correlation id is free again once its request is answered or has timed out."""
    return exchange.correlate(*_reused(spark, d), 3_600_000_000).select("request_id", "reply_id", "result")


@query(REUSED + "select event_id as reply_id from f where fate = 'unmatched'")
def reply_unmatched_reuse(spark: SparkSession, d: str) -> DataFrame:
    requests, replies = _reused(spark, d)
    return exchange.unmatched(replies, exchange.correlate(requests, replies, 3_600_000_000)).select("reply_id")


@query("""select cast(event_id as varchar) as message_id, cast(user_id as varchar) as correlation_id, true as fresh,
  cast(case when event_id % 5 = 4 then 504 else 200 end as integer) as status, case when event_id % 5 < 4 then 'done ' || event_type end as body, case when event_id % 5 < 4 then 'text/plain' end as content_type from events""")
def gateway_request_reply(spark: SparkSession, d: str) -> DataFrame:
    """Request, fresh correlation key, reply, status and response of every message in one plan."""
    msgs = envelope.events(spark, d).select("message_id", "correlation_id", "ts", F.col("payload.type").alias("type"))
    sent = exchange.outbound(msgs, exchange.fresh_key("message_id"))
    requests = sent.select(F.col("message_id").alias("request_id"), "correlation_id", F.col("ts").alias("sent_at"))
    n = F.col("message_id").cast("bigint") % 5
    # the fifth reply comes a minute late
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.when(n == 4, 91_000_000).otherwise(n * 1_000_000)).cast("timestamp_ntz")
    replies = sent.select(F.concat(F.lit("a"), F.col("message_id")).alias("reply_id"), "correlation_id", at.alias("replied_at"), F.concat(F.lit("done "), F.col("type")).alias("body"))
    answered = exchange.gateway(sent, exchange.correlate(requests, replies), replies.select("reply_id", "body"))
    response = http.respond(answered, F.col("result"), F.col("body"), F.lit("text/plain"))
    fresh = (F.col("key") != F.col("message_id")) & F.col("key").rlike("^[0-9a-f]{32}$")
    return response.select("message_id", "correlation_id", fresh.alias("fresh"), "status", "body", "content_type")


@query("select count(*) as n, count(*) as n_distinct, count(*) as n_formed from events")
def random_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of messages that have none: 32 hex digits, none twice."""
    df = read(spark, d, "events").select(envelope.random_id().alias("i"))
    return df.agg(F.count("*").alias("n"), F.countDistinct("i").alias("n_distinct"), F.count(F.when(F.col("i").rlike("^[0-9a-f]{32}$"), 1)).alias("n_formed"))


@query("select cast(event_id as varchar) as message_id, case when event_id % 3 > 0 then cast(user_id as varchar) end as correlation_id, 'x-' || event_id as exchange_id from events")
def correlation_restore(spark: SparkSession, d: str) -> DataFrame:
    """An exchange in mid-flow gives the caller's correlation id back, and none if there was none."""
    msgs = envelope.events(spark, d).withColumn("correlation_id", F.when(F.col("message_id").cast("bigint") % 3 > 0, F.col("correlation_id")))
    out = exchange.outbound(msgs, F.concat(F.lit("x-"), F.col("message_id"))).withColumn("exchange_id", F.col("correlation_id"))
    return exchange.restore(out).select("message_id", "correlation_id", "exchange_id")


#: Headers of every JSON type beside the number that the table has.
KINDS_JSON = ("x-custom", "five", "flag", "gone", "nested", 'quo"ted')
STAMP_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(ts) % 1000000 = 0 then '' else '.' || rtrim(strftime(ts, '%f'), '0') end || 'Z'"


def _many_headers(spark: SparkSession, d: str) -> DataFrame:
    df = envelope.events(spark, d)
    h = F.col("headers")
    values = (F.concat(F.lit('say "'), F.col("payload.type"), F.lit('"\n')), F.lit("5"), F.col("message_id").cast("bigint") % 2 == 0, F.lit(None).cast("string"), F.struct(F.array(F.lit(1), F.lit(2)).alias("a"), F.lit("b").alias("t")), F.lit(1.5))
    for key, value in zip(KINDS_JSON, values):
        h = envelope.with_header(h, key, value)
    return df.withColumn("headers", h)


@query(f"""select cast(event_id as varchar) as message_id,
  '{{"content-type":"application/json","correlation-id":"' || user_id || '","five":"5","flag":' || (event_id % 2 = 0) || ',"gone":null,"k":' || {K} || ',"message-id":"' || event_id
  || '","nested":{{"a":[1,2],"t":"b"}},"quo\\"ted":1.5,"timestamp":"' || {STAMP_SQL} || '","x-custom":"say \\"' || event_type || '\\"\\n"}}' as headers_json from events""")
def header_framing(spark: SparkSession, d: str) -> DataFrame:
    """Headers of every JSON type on the wire."""
    df = _many_headers(spark, d)
    return df.select("message_id", envelope.encode_headers(df).alias("headers_json"))


@query(f"""select cast(event_id as varchar) as message_id, cast(event_id as varchar) as id2, cast(user_id as varchar) as correlation_id, ts, {K} as k, false as decode_error,
  'say "' || event_type || '"' || chr(10) as custom, cast(null as bigint) as five_as_int, '5' as five, case when event_id % 2 = 0 then 'true' else 'false' end as flag, 'null' as gone,
  '{{"a":[1,2],"t":"b"}}' as nested, '1.5' as quoted, 7::bigint as n_headers, cast(event_id % 9 as integer) as delivery_count, true as same from events""")
def header_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Strings, numbers, booleans, null, nested values and keys with quotes survive; encoding again gives the same text."""
    df = _many_headers(spark, d).withColumn("delivery_count", (F.col("message_id").cast("bigint") % 9).cast("int"))
    wire = df.select(F.col("message_id").alias("id2"), envelope.encode_headers(df).alias("headers_json"))
    back = envelope.decode_headers(wire)
    h = F.col("headers")
    return back.select(
        "message_id", "id2", "correlation_id", F.col("ts").cast("timestamp_ntz").alias("ts"), envelope.header_int(h, "k").alias("k"), "decode_error",
        envelope.header_string(h, "x-custom").alias("custom"), envelope.header_int(h, "five").alias("five_as_int"), envelope.header_string(h, "five").alias("five"),
        envelope.header(h, "flag").alias("flag"), envelope.header(h, "gone").alias("gone"), envelope.header(h, "nested").alias("nested"), envelope.header(h, 'quo"ted').alias("quoted"),
        F.size(h).cast("bigint").alias("n_headers"), "delivery_count", (envelope.encode_headers(back) == F.col("headers_json")).alias("same"),
    )


@query(f"select cast(event_id as varchar) as message_id, unnest(['k', 'x']) as key, unnest([cast({K} as varchar), '7']) as value from events")
def header_ops(spark: SparkSession, d: str) -> DataFrame:
    """Set, remove and list headers."""
    df = envelope.events(spark, d)
    h = envelope.with_header(envelope.with_header(F.col("headers"), "x", F.lit(7)), "y", F.lit("gone"))
    return envelope.all_headers(df.withColumn("headers", envelope.without_headers(h, ["y"])))


@query("select event_id, event_type as type, value from events")
def payload_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    df = envelope.events(spark, d).select(F.col("message_id").cast("bigint").alias("event_id"), F.to_json("payload").alias("wire"))
    back = df.withColumn("p", F.from_json("wire", "type string, value double"))
    return back.select("event_id", "p.type", "p.value")


@query("select event_id, event_id % 5 = 0 as invalid from events")
def invalid_decode(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that aren't of their type are told apart, the others decode."""
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"value":'), F.col("event_type"))).otherwise(F.to_json(F.struct("value"))).alias("wire"))
    p = F.from_json("wire", "value double, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return e.withColumn("p", p).select("event_id", F.col("p._bad").isNotNull().alias("invalid"))
