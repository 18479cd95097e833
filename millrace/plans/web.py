"""Queries of the HTTP, event-stream and scheduling operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import http
from millrace.sources import cron, sse

from .base import query, read

NOW = "1994-11-06 08:49:00"
STATUSES = (200, 204, 301, 400, 404, 408, 429, 500, 503)
KINDS = ("timeout", "closed", "overflow", "duplicate", "panic", "too_large", "decode", "payload_type", "no_correlation", None, "other")


def _pick(values: tuple, key: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


def _after() -> Column:
    m = F.col("event_id") % 4
    return F.when(m == 0, "7").when(m == 1, "Sun, 06 Nov 1994 08:49:37 GMT").when(m == 2, "Sat, 05 Nov 1994 08:49:37 GMT").otherwise("soon")


AFTER_FORMS = ("7", "Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994", "Sat, 05 Nov 1994 08:49:37 GMT", "9223372036", "9223372037", "-1", " 12 ", "+3", "soon", "", None, "1.5", "Sun, 6 Nov 1994 08:49:37 GMT")
AFTER_SECONDS = "[7, 37, 37, 37, 0, 9223372036, null, null, 12, 3, null, null, null, null, null]"


@query(f"select event_id, cast({AFTER_SECONDS}[event_id % 15 + 1] as double) as seconds from events")
def retry_after(spark: SparkSession, d: str) -> DataFrame:
    """Seconds up to 64 bits of nanoseconds, and the three forms of a date."""
    return read(spark, d, "events").select("event_id", http.retry_after_seconds(_pick(AFTER_FORMS, "event_id"), F.lit(NOW).cast("timestamp")).alias("seconds"))


@query(f"""with a as (select event_id, [{', '.join(map(str, STATUSES))}][event_id % {len(STATUSES)} + 1] as status, event_id % 4 <> 3 as after from events)
select event_id, status, case when status between 200 and 299 then null when status < 500 and status not in (408, 429) then 'permanent'
  when status in (429, 503) and after then 'retry_after' else 'transient' end as error from a""")
def http_status_classify(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events").select("event_id", _pick(STATUSES, "event_id").alias("status"), http.retry_after_seconds(_after(), F.lit(NOW).cast("timestamp")).alias("after"))
    return df.select("event_id", "status", http.classify_response(F.col("status"), F.col("after")).alias("error"))


@query(f"""with a as (select event_id, {str(list(KINDS)).replace('None', 'null')}[event_id % {len(KINDS)} + 1] as kind from events)
select event_id, cast(case kind when 'timeout' then 504 when 'closed' then 503 when 'duplicate' then 409 when 'too_large' then 413 when 'decode' then 400 else 500 end as integer) as status from a""")
def error_status(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", http.error_status(_pick(KINDS, "event_id")).alias("status"))


@query("""select cast(doc_id as varchar) as message_id, case when doc_id % 2 = 0 then 'u' || doc_id else cast(doc_id as varchar) end as correlation_id,
  'c' || doc_id as http_correlation_id, source as x_source, 'POST' as method, cast(null as varchar) as hidden, case when strlen(text) > 4000 then 'too_large' end as error from documents""")
def http_decode_request(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    headers = F.create_map(F.lit("X-Source"), F.col("source"), F.lit("mr-hidden"), F.lit("1"), F.lit("Cookie"), F.lit("s"))
    r = docs.select(F.col("doc_id").cast("string").alias("message_id"), F.lit("POST").alias("method"), F.lit("/in").alias("path"), F.lit("").alias("query"), F.col("text").alias("body"), headers.alias("request_headers"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("advisory_id"))
    trusted = F.when(F.col("message_id").cast("bigint") % 2 == 0, F.concat(F.lit("u"), F.col("message_id")))
    out = http.decode_request(r, ["x-source", "mr-hidden"], 4000, trusted)
    h = lambda k: F.try_element_at("headers", F.lit(k))
    return out.select("message_id", "correlation_id", "http_correlation_id", h("X-Source").alias("x_source"), h("http.method").alias("method"), h("mr-hidden").alias("hidden"), "error")


@query("select event_id, cast(event_id as varchar) as x, case when event_type = 'view' then 'text/plain' else 'application/octet-stream' end as content_type, 1::bigint as n_out from events")
def http_encode(spark: SparkSession, d: str) -> DataFrame:
    """What leaves with a request and a response."""
    h = F.create_map(F.lit("x"), F.col("event_id").cast("string"), F.lit("y"), F.lit("1"), F.lit("mr-a"), F.lit("2"))
    out = read(spark, d, "events").withColumn("h", http.encode_request(h, ["x", "mr-a"]))
    ct = http.content_type(F.when(F.col("event_type") == "view", "text/plain").when(F.col("event_type") == "click", ""))
    return out.select("event_id", F.try_element_at("h", F.lit("x")).alias("x"), ct.alias("content_type"), F.size("h").cast("bigint").alias("n_out"))


@query("""select event_id, case when event_id % 2 = 0 then 'http.content-type=text/xevil,' else '' end || 'http.correlation-id=' || event_id || ',trace=' || user_id || ',z='
  || case when event_id % 3 = 0 then 'old' else event_type || 'x' end as headers from events""")
def http_reply_headers(spark: SparkSession, d: str) -> DataFrame:
    """What describes the request goes, its advisory correlation id stays; the remote's values lose line breaks."""
    lit = F.lit
    req = F.create_map(lit("message-id"), lit("m"), lit("http.path"), lit("/"), lit("http.content-type"), lit("old/type"), lit("http.correlation-id"), F.col("event_id").cast("string"), lit("trace"), F.col("user_id").cast("string"), lit("z"), lit("old"))
    value = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat("event_type", lit("\r\nx")))
    rep = F.create_map(lit("z"), value, lit("secret"), lit("s"), lit("mr-forged"), lit("f"))
    kind = F.when(F.col("event_id") % 2 == 0, "text/x\r\nevil")
    merged = F.array_sort(F.map_entries(http.build_reply(req, rep, ["z", "mr-forged"], kind)))
    return read(spark, d, "events").select("event_id", F.array_join(F.transform(merged, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("headers"))


@query("""select event_id, case when event_id % 10 = 0 then null else 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: a' || chr(10) || 'data: ' || user_id || chr(10) || chr(10) end as frame from events""")
def sse_frame(spark: SparkSession, d: str) -> DataFrame:
    sid = F.when(F.col("event_id") % 10 == 0, F.concat(F.col("event_id").cast("string"), F.lit("\n"))).otherwise(F.col("event_id").cast("string"))
    return read(spark, d, "events").select("event_id", http.sse_frame(sid, F.col("event_type"), F.concat(F.lit("a\r\n"), F.col("user_id").cast("string"))).alias("frame"))


@query("""with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as seq from events)
select cast(user_id as varchar) as stream_id, cast(seq as bigint) as seq, cast(event_id as varchar) as event_id, event_type as event, 'a' || chr(10) || event_id as data from e""")
def sse_parse(spark: SparkSession, d: str) -> DataFrame:
    """Streams of frames, parsed back to events."""
    frame = http.sse_frame(F.col("event_id").cast("string"), F.col("event_type"), F.concat(F.lit("a\r"), F.col("event_id").cast("string")))
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.struct("ts", "event_id", frame.alias("f")).alias("x"))
    captures = e.groupBy("stream_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    text = F.concat(F.lit("\ufeff: hello\n\n"), F.array_join(F.transform("x", lambda x: x["f"]), ""), F.lit("data: cut off"))
    return sse.parse_streams(captures.select("stream_id", text.alias("text"))).select("stream_id", "seq", "event_id", "event", "data")


REPLAY = """
with e as (select user_id, event_id, 'e' || event_id % 50 as sid, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events),
ring as (select * from e where back <= 30),
last as (select user_id, min(back) as b from ring where sid = 'e7' group by 1)
select r.event_id from ring r join last l on r.user_id = l.user_id and r.back < l.b
"""


@query(REPLAY)
def sse_replay(spark: SparkSession, d: str) -> DataFrame:
    """The last 30 events of a stream, and what a client that saw id e7 has missed."""
    e = read(spark, d, "events").withColumn("seq", F.struct("ts", "event_id")).withColumn("sid", F.concat(F.lit("e"), (F.col("event_id") % 50).cast("string")))
    ring = http.replay_ring(e, "user_id", "seq", 30)
    clients = e.select("user_id").distinct().select(F.col("user_id").cast("string").alias("client"), "user_id", F.lit("e7").alias("last_id"))
    return http.replay_after(ring, clients, "user_id", "seq", "sid").select("event_id")


@query("select page_id, regexp_matches(url, '^(?i)https?://[^/?#[:space:]]+') as valid from pages")
def url_valid(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", http.valid_url(F.col("url")).alias("valid"))


@query("select doc_id, regexp_matches(source, '^[A-Za-z_][A-Za-z0-9_]*$') as valid, '\"' || replace(lang || '\"', '\"', '\"\"') || '\"' as quoted from documents")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", http.valid_identifier(F.col("source")).alias("valid"), http.quote_identifier(F.concat("lang", F.lit('"'))).alias("quoted"))


@query("""select ts as fire_ts from generate_series(timestamp '1995-01-01 00:00:00', timestamp '1995-04-01 00:00:00', interval 1 minute) g(ts)
where ts > timestamp '1995-01-01 00:00:00' and minute(ts) % 20 = 5 and hour(ts) between 8 and 17 and month(ts) in (1, 3) and (day(ts) = 13 or dayofweek(ts) in (1, 5))""")
def cron_grid(spark: SparkSession, d: str) -> DataFrame:
    return cron.fires(spark, cron.parse("5/20 8-17 13 jan,mar mon,fri"), "1995-01-01 00:00:00", "1995-04-01 00:00:00")


@query("select ts as fire_ts from generate_series(timestamp '1995-01-01 01:30:00', timestamp '1995-01-03 00:00:00', interval 90 minute) g(ts)")
def cron_every(spark: SparkSession, d: str) -> DataFrame:
    return cron.fires(spark, cron.parse("@every 1h30m"), "1995-01-01 00:00:00", "1995-01-03 00:00:00")


@query("""with c as (select event_type as scope, date_trunc('hour', ts) as fire_ts, event_id, row_number() over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) as n from events)
select event_id, n = 1 as won from c""")
def cron_single_fire(spark: SparkSession, d: str) -> DataFrame:
    claims = read(spark, d, "events").select(F.col("event_type").alias("scope"), F.date_trunc("hour", "ts").alias("fire_ts"), "ts", "event_id")
    return cron.single_fire(claims, ["ts", "event_id"]).select("event_id", "won")


@query("""with recursive o as (select event_type as scope, event_id, user_id % 3 as holder, epoch_us(ts) as t, row_number() over (partition by event_type order by ts, event_id) as rn from events),
f as (
  select scope, event_id, rn, true as leader, holder as h, t + 1800000000 as until_us from o where rn = 1
  union all
  select o.scope, o.event_id, o.rn, f.h = o.holder or f.until_us <= o.t, case when f.h = o.holder or f.until_us <= o.t then o.holder else f.h end,
    case when f.h = o.holder or f.until_us <= o.t then o.t + 1800000000 else f.until_us end
  from f join o on o.scope = f.scope and o.rn = f.rn + 1
) select event_id, leader, until_us from f""")
def elector_lease(spark: SparkSession, d: str) -> DataFrame:
    claims = read(spark, d, "events").select(F.col("event_type").alias("scope"), "event_id", (F.col("user_id") % 3).alias("holder"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return cron.elect(claims, "at_us", ["at_us", "event_id"], 1_800_000_000).select("event_id", "leader", "until_us")


@query("select ts - interval 1 hour as fire_ts from generate_series(timestamp '1995-01-01 01:00:00', timestamp '1995-01-20 01:00:00', interval 1 minute) g(ts) where minute(ts) = 30 and hour(ts) = 0 and ts - interval 1 hour > timestamp '1995-01-01 00:00:00'")
def cron_zone(spark: SparkSession, d: str) -> DataFrame:
    """Half past midnight in Berlin, in winter an hour ahead of UTC."""
    return cron.fires(spark, cron.parse("30 0 * * *"), "1995-01-01 00:00:00", "1995-01-20 00:00:00", "Europe/Berlin")
