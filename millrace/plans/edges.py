"""Queries of the edges of a flow: terminal steps, sinks, codecs, handlers in Python, stores, schedules."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import envelope
from millrace.functions import codecs, http
from millrace.operators import flow, groupstore, handlers, queue, settle
from millrace.operators.settle import Backoff, RetryPolicy
from millrace.sources import cron, memory, spool
from millrace.streaming import sinks

from .base import query, read
from .delivery import ERROR_SQL, event_error
from .streams import _events, _folder


@query("""select case when event_type = 'purchase' then 'billing' when value > 50 then 'big' else 'rest' end as sink, count(*) as n, 0::bigint as n_on from events group by 1""")
def to_sink(spark: SparkSession, d: str) -> DataFrame:
    """Terminal steps write to their sinks and let nothing on: every message is in one place."""
    at = _folder(spark, "to")
    write = lambda name: lambda df: df.select("message_id").write.parquet(f"{at}/{name}")
    first = flow.chain(flow.filter_(F.col("payload.type") == "purchase", "others"), flow.to(write("billing"), "billing"))(envelope.events(spark, d))
    second = flow.chain(flow.filter_(F.col("payload.value") > 50, "small"), flow.consume(write("big")))(first.sides["others"])
    third = flow.chain(flow.to(write("rest")))(second.sides["small"])
    for out in (first, second, third):
        flow.deliver(out)
    found = None
    for name, out in (("billing", first), ("big", second), ("rest", third)):
        n_on = out.main.count()
        one = spark.read.parquet(f"{at}/{name}").agg(F.lit(name).alias("sink"), F.count("*").alias("n"), F.lit(n_on).cast("bigint").alias("n_on"))
        found = one if found is None else found.unionByName(one)
    return found


@query(f"""with a as (select event_id, {ERROR_SQL} as err, cast(event_id % 5 + 1 as integer) as n, event_id % 3 = 0 as refused from events),
o as (select *, case when err is null then 'ack' when err = 'permanent' then 'invalid' when n >= 4 then 'dead_letter' else 'retry' end as first from a)
select event_id, case when first in ('invalid', 'dead_letter') and refused then 'retry' else first end as outcome, first in ('invalid', 'dead_letter') and not refused as diverted,
  case when first in ('invalid', 'dead_letter') and refused or first = 'retry' then least(20.0, 1.5 * pow(3.0, n - 1)) end as delay,
  case when first = 'ack' then 'acked' when first = 'retry' or refused then 'retried' when first = 'invalid' then 'invalid' else 'dead_lettered' end as event from o""")
def divert_refused(spark: SparkSession, d: str) -> DataFrame:
    """A message that its invalid or dead-letter sink refuses is tried again after a backoff."""
    policy, n = RetryPolicy(Backoff(1.5, 3.0, 20.0), 4, True), (F.col("event_id") % 5 + 1).cast("int")
    done = settle.settle(read(spark, d, "events"), event_error(), n, policy)
    return settle.divert(done, F.col("event_id") % 3 == 0, n, policy).select("event_id", "outcome", "diverted", "delay", "event")


@query("select event_id, event_type as type, 'm-' || event_id as sent_id, value > 60 as sent from events where event_type <> 'view'")
def outbox_stream(spark: SparkSession, d: str) -> DataFrame:
    """Business rows and the messages that go with them, written in one micro-batch; run twice, they are there once."""
    at = _folder(spark, "outbox")

    def handler(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = batch.where("event_type <> 'view'").select("event_id", F.col("event_type").alias("type"), "value")
        return rows.drop("value"), rows.where("value > 60").select("event_id", F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("sent_id"))

    for _ in range(2):
        sinks.outbox(_events(spark, d), handler, f"{at}/rows", f"{at}/sent", f"{at}/state").awaitTermination()
    rows = spark.read.parquet(f"{at}/rows").select("event_id", "type")
    sent = spark.read.parquet(f"{at}/sent").select(F.col("event_id").alias("of"), F.lit(True).alias("sent"))
    joined = rows.join(sent, F.col("event_id") == F.col("of"), "left")
    return joined.select("event_id", "type", F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("sent_id"), F.coalesce("sent", F.lit(False)).alias("sent"))


@query("""select event_id, case event_id % 10 when 0 then 'transient' when 1 then 'permanent' when 2 then 'retry_after' when 3 then 'transient' end as error,
  case when event_id % 10 > 3 then value * 2 end as result, case when event_id % 10 = 2 then 7.0 end::double as wait from events""")
def handler_isolated(spark: SparkSession, d: str) -> DataFrame:
    """A handler that raises, or returns something else, fails its message only."""

    def handler(row: dict) -> object:
        kind = row["event_id"] % 10
        if kind == 0:
            raise ZeroDivisionError("boom")
        if kind == 1:
            raise handlers.PermanentError("never")
        if kind == 2:
            raise handlers.RetryAfterError(7)
        return "not a number" if kind == 3 else row["value"] * 2

    rows = read(spark, d, "events").select("event_id", "value")
    return handlers.handled(rows, handler, "double").select("event_id", "error", "result", "wait")


@query("""select user_id % 50 || '-' || event_id || '#' || i as message_id, cast(i as integer) as sequence_number, cast(event_id % 4 as integer) as sequence_size, event_type || i as payload
  from events, unnest(range(1, event_id % 4 + 1)) as u(i) where event_id % 7 > 0""")
def split_function(spark: SparkSession, d: str) -> DataFrame:
    """A message for each element that a function gives, and none where it fails."""

    def splitter(row: dict) -> list:
        if row["n"] % 7 == 0:
            raise ValueError("can't be split")
        return [f"{row['kind']}{i}" for i in range(1, row["n"] % 4 + 1)]

    e = read(spark, d, "events")
    rows = e.select(F.concat_ws("-", (F.col("user_id") % 50).cast("string"), F.col("event_id").cast("string")).alias("message_id"), F.lit(None).cast("string").alias("correlation_id"), F.col("event_id").alias("n"), F.col("event_type").alias("kind"))
    children, failed = handlers.split_by(rows, splitter, "string", ["n", "kind"])
    return children.select("message_id", "sequence_number", "sequence_size", "payload")


@query("""select event_id, event_id % 6 not in (0, 1, 4) as fine, case when event_id % 6 in (2, 3, 5) then case when event_id % 6 = 5 then null else value end end as value, case when event_id % 6 in (2, 3) then event_type end as type from events""")
def codec_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON on the wire: cut off, of another type, whole, with more fields, null."""
    codec = codecs.Json("struct<type: string, value: double>")
    e = read(spark, d, "events").withColumn("p", F.struct(F.col("event_type").alias("type"), "value"))
    m, text = F.col("event_id") % 6, codec.encode(F.col("p")).cast("string")
    wire = F.when(m == 0, F.substring(text, 1, 12)).when(m == 1, F.lit('{"type":"x","value":"much"}')).when(m == 3, F.concat(F.lit('{"more":[1],'), F.substring(text, F.lit(2), F.length(text)))).when(m == 4, F.lit("17 rest")).when(m == 5, F.lit("null")).otherwise(text)
    value, bad = codec.decode(wire.cast("binary"))
    return e.select("event_id", (~bad).alias("fine"), value["value"].alias("value"), value["type"].alias("type"))


@query("select doc_id, true as same, true as as_is from documents")
def codec_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes pass unchanged both ways; without that codec they would be JSON."""
    codec = codecs.resolve(False, codecs.Bytes(), "binary")
    wire = codec.encode(F.col("text"))
    back, bad = codec.decode(wire)
    same = F.coalesce(back.eqNullSafe(F.col("text").cast("binary")) & ~bad, F.lit(False))
    return read(spark, d, "documents").select("doc_id", same.alias("same"), wire.cast("string").eqNullSafe(F.col("text")).alias("as_is"))


@query("""select 'beat@' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as message_id, 'tick ' || hour(ts) as payload, ts from generate_series(timestamp '1995-01-01 00:00:00', timestamp '1995-02-01 00:00:00', interval 1 hour) g(ts)
where ts > timestamp '1995-01-01 00:00:00' and hour(ts) % 6 = 0 and (day(ts) % 2 = 1 or dayofweek(ts) = 1)""")
def cron_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a schedule; every second day or on Mondays, as a step leaves the days no longer open."""
    fired = cron.fires(spark, cron.parse("0 */6 */2 * mon"), "1995-01-01 00:00:00", "1995-02-01 00:00:00")
    out = cron.messages(fired, lambda t: F.concat(F.lit("tick "), F.hour(t).cast("string")), "beat")
    return out.select("message_id", "payload", "ts")


@query("select count(*) as n, true as inside, true as capped, true as spread from events")
def backoff_jitter(spark: SparkSession, d: str) -> DataFrame:
    """Delays spread by a quarter to either side, never above the cap."""
    n = (F.col("event_id") % 12).cast("int")
    rows = read(spark, d, "events").select(Backoff(0.5, 2.0, 60.0).delay(n).alias("plain"), Backoff(0.5, 2.0, 60.0, 0.25, 3).delay(n).alias("wide"))
    inside = (F.col("wide") >= F.col("plain") * 0.75 - 1e-9) & (F.col("wide") <= F.col("plain") * 1.25 + 1e-9)
    return rows.agg(F.count("*").alias("n"), F.min(inside).alias("inside"), F.min(F.col("wide") <= 60).alias("capped"), (F.countDistinct("wide") > 100).alias("spread"))


@query("""with recursive o as (select user_id, event_id, epoch_us(ts) as t, event_id % 6 as c, 'm' || event_id % 7 as m, event_id % 3 as given, row_number() over (partition by user_id order by ts, event_id) as rn from events),
f as (
  select user_id, event_id, rn, case when c < 3 then [{'m': m, 'e': -1}] else [] end as live, 0 as epoch, cast(null as bigint) as locked, case when c < 3 then t end as made, case when c < 3 then 'added' when c = 3 then 'nothing' else 'stale' end as result from o where rn = 1
  union all
  select o.user_id, o.event_id, o.rn,
    case when o.c < 3 and not list_contains(list_transform(f.live, lambda x: x.m), o.m) then list_append(f.live, {'m': o.m, 'e': -1})
         when o.c = 3 and len(f.live) > 0 and (f.locked is null or o.t - f.locked >= 300000000) then list_transform(f.live, lambda x: {'m': x.m, 'e': f.epoch + 1})
         when o.c = 4 and o.given = f.epoch and f.locked is not null then list_filter(f.live, lambda x: x.e <> f.epoch) else f.live end,
    case when o.c = 3 and len(f.live) > 0 and (f.locked is null or o.t - f.locked >= 300000000) then f.epoch + 1 else f.epoch end,
    case when o.c = 3 and len(f.live) > 0 and (f.locked is null or o.t - f.locked >= 300000000) then o.t when o.c > 3 and o.given = f.epoch and f.locked is not null then null else f.locked end,
    case when o.c < 3 and not list_contains(list_transform(f.live, lambda x: x.m), o.m) then coalesce(f.made, o.t)
         when o.c = 4 and o.given = f.epoch and f.locked is not null then case when len(list_filter(f.live, lambda x: x.e <> f.epoch)) > 0 then o.t end else f.made end,
    case when o.c < 3 then case when list_contains(list_transform(f.live, lambda x: x.m), o.m) then 'repeated' else 'added' end
         when o.c = 3 then case when len(f.live) > 0 and (f.locked is null or o.t - f.locked >= 300000000) then 'claimed' else 'nothing' end
         when o.given = f.epoch and f.locked is not null then case when o.c = 4 then 'settled' else 'abandoned' end else 'stale' end
  from f join o on o.user_id = f.user_id and o.rn = f.rn + 1
) select f.event_id, cast(f.user_id as varchar) as group_key, case when c < 3 then 'add' when c = 3 then 'claim' when c = 4 then 'settle' else 'abandon' end as command, o.m as message_id, given as epoch_given, t as at_us,
  result, array_to_string(list_transform(live, lambda x: x.m), ',') as members, cast(epoch as bigint) as epoch, made as created_us from f join o on o.event_id = f.event_id""")
def group_store_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as commands on leased groups."""
    return groupstore.replay(_log(spark, d), ["at_us", "event_id"])


def _log(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 6
    command = F.when(m < 3, "add").when(m == 3, "claim").when(m == 4, "settle").otherwise("abandon")
    e = read(spark, d, "events").withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select(F.col("user_id").cast("string").alias("group_key"), "event_id", command.alias("command"), F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string")).alias("message_id"), (F.col("event_id") % 3).alias("epoch_given"), "at_us")


@query("""with m as (select user_id, 'm' || i as message_id, min(case when event_id % 7 = i and event_id % 6 < 3 then epoch_us(ts) end) as seq from events, range(7) r(i) group by all having seq is not null),
b as (select user_id, min(seq) as born from m group by 1),
c as (select user_id, min(epoch_us(ts)) as t from events join b using (user_id) where event_id % 6 = 3 and epoch_us(ts) > born group by 1)
select cast(user_id as varchar) as group_key, message_id, seq from m join c using (user_id) where seq < t""")
def claimed_members(spark: SparkSession, d: str) -> DataFrame:
    """The members that the first claim of a group with members hands out; before it nothing settles."""
    log = _log(spark, d)
    members = log.where("command = 'add'").groupBy("group_key", "message_id").agg(F.min("at_us").alias("seq"))
    handed = groupstore.claimed_members(log, members, ["at_us", "event_id"])
    return handed.where("epoch = 1").select("group_key", "message_id", "seq")


@query("select cast(event_id as varchar) as message_id, cast(null as varchar) as body, cast(case when event_id % 9 = 0 then 413 when event_id % 9 = 1 then 400 else 202 end as integer) as status from events")
def http_async_inbound(spark: SparkSession, d: str) -> DataFrame:
    """Requests that nobody waits for: accepted, or refused for what is wrong with them."""
    m = F.col("event_id") % 9
    rows = read(spark, d, "events").withColumn("message_id", F.col("event_id").cast("string"))
    done = http.respond(rows, F.when(m == 0, "too_large").when(m == 1, "decode"), F.col("event_type"), F.lit("text/plain"), asynchronous=True)
    return done.select("message_id", "body", "status")


@query("select cast(item_id as varchar) as message_id, text as payload, 'n/' || length(text) as headers from benchmark")
def spool_stream(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a spool folder, seven at a poll, over several files. A spool is the driver's own folder."""
    at = _folder(spark, "spool")
    rows = read(spark, d, "benchmark").orderBy("item_id").toArrow().to_pylist()
    with tempfile.TemporaryDirectory(prefix="millrace-spool-") as folder:
        for k in range(0, len(rows), 13):
            lines = [json.dumps({"message_id": str(r["item_id"]), "payload": r["text"], "headers": f"n/{len(r['text'])}"}) for r in rows[k : k + 13]]
            (Path(folder) / f"{k:06}.jsonl").write_text("\n".join(lines) + "\n")
        spool.register(spark)
        stream = spark.readStream.format("spool").option("path", folder).option("maxPerPoll", 7).load()
        query_ = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").start()
        try:
            query_.processAllAvailable()
        finally:
            sinks.stop_gracefully(query_)
    return spark.read.schema(spool.SCHEMA).parquet(f"{at}/out").select("message_id", "payload", "headers")


@query("select cast(n_nationkey as varchar) as message_id, cast(row_number() over (order by n_nationkey % 3 = 0, n_nationkey) as bigint) as place from nation")
def memory_broker(spark: SparkSession, d: str) -> DataFrame:
    """A broker in process: every third message is refused once and comes again at the tail."""
    broker = memory.Broker()
    key = F.col("n_nationkey").cast("string")
    broker.send(read(spark, d, "nation").orderBy("n_nationkey").select(key.alias("message_id"), F.lit(None).cast("string").alias("correlation_id"), F.col("n_name").alias("payload")))
    order, again = [], set()
    while len(broker):
        for r in broker.poll(spark, 10).collect():
            if int(r.message_id) % 3 == 0 and r.message_id not in again:
                again.add(r.message_id)
                broker.nack(r.message_id)
            else:
                broker.ack(r.message_id)
                order.append(r.message_id)
    return spark.createDataFrame([(m, i) for i, m in enumerate(order, 1)], "message_id string, place long")


@query("""select count(*) as n_sent, count(*) filter (where o_orderkey % 4 <> 3) as n_visible, least(100, count(*) filter (where o_orderkey % 4 <> 3)) as n_polled, true as right_ones from orders""")
def queue_channel(spark: SparkSession, d: str) -> DataFrame:
    """What is sent to a channel over a queue table can be polled once it is visible, a hundred at a time."""
    from millrace.sources import tables

    at, name = _folder(spark, "channel"), f"channel_{uuid.uuid4().hex}"
    spark.sql(f"{tables.ddl('queue', name)} LOCATION '{at}/{name}'")
    try:
        channel = queue.QueueChannel(spark, name)
        key = F.col("o_orderkey")
        rows = read(spark, d, "orders").select(key.cast("string").alias("message_id"), F.lit("{}").alias("headers"), F.col("o_orderstatus").alias("payload"), (key % 4 == 3).alias("later"))
        channel.send(rows, F.lit("2020-01-01 00:00:00").cast("timestamp"), F.when(F.col("later"), 3_600_000_000).otherwise(0))
        tables.ready(spark, "queue", name)
        now = F.lit("2020-01-01 00:00:01").cast("timestamp")
        whole = spark.table(name).agg(F.count("*").alias("n_sent"), F.count(F.when(F.col("visible_after") <= now, 1)).alias("n_visible"))
        right = (F.col("msg_id").cast("bigint") % 4 != 3) & (F.col("delivery_count") == 1) & (F.col("locked_by") == "me") & (F.col("lease_epoch") == 1)
        polled = channel.poll(now, 100, "me").agg(F.count("*").alias("n_polled"), F.min(right).alias("right_ones"))
        counts = {**whole.first().asDict(), **polled.first().asDict()}
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.createDataFrame([counts], "n_sent long, n_visible long, n_polled long, right_ones boolean")
