import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import envelope
from millrace.operators import aggregate, exchange, flow
from millrace.plans import catalog, messages


@pytest.fixture(scope="module")
def orders(spark):
    rows = [("o-1", None, ["a", "b", "c"], True), ("o-2", "c-9", [], False), (None, None, ["z"], True)]
    return spark.createDataFrame(rows, "message_id string, correlation_id string, payload array<string>, paid boolean")


def test_filter_is_a_partition_of_its_input(orders):
    out = flow.chain(flow.filter_(F.col("paid"), "rejected"))(orders)
    assert out.main.count() + out.sides["rejected"].count() == orders.count()
    assert [r.message_id for r in out.sides["rejected"].collect()] == ["o-2"]


def test_split_stamps_and_empty_gives_nothing(orders):
    got = flow.split(F.col("payload"))(orders.withColumns({"sequence_number": F.lit(None).cast("int"), "sequence_size": F.lit(None).cast("int")})).collect()
    assert [(r.message_id, r.correlation_id, r.sequence_number, r.sequence_size, r.payload) for r in got] == [
        ("o-1#1", "o-1", 1, 3, "a"), ("o-1#2", "o-1", 2, 3, "b"), ("o-1#3", "o-1", 3, 3, "c"), (None, None, 1, 1, "z"),
    ]


def test_router_needs_routes_and_channels(orders):
    with pytest.raises(flow.FlowError):
        flow.route(F.col("message_id"), {})
    with pytest.raises(flow.FlowError):
        flow.route(F.col("message_id"), {"a": ""})
    routed = flow.route(F.col("message_id"), {"o-1": "one"})(orders)
    assert {r.message_id for r in flow.unrouted(routed).collect()} == {"o-2", None}
    assert flow.branches(routed, ["one"])["one"].count() == 1


def test_channels_have_one_subscriber(orders):
    channel = flow.DirectChannel("orders")
    with pytest.raises(flow.SubscriptionError):
        channel.send(orders)
    with pytest.raises(flow.SubscriptionError):
        channel.subscribe(None)
    channel.subscribe(lambda df: df.limit(1))
    with pytest.raises(flow.SubscriptionError):
        channel.subscribe(lambda df: df)
    assert channel.send(orders).count() == 1


def test_topics_are_forgotten_when_empty(spark):
    topics = flow.Topics()
    n = topics.subscribe("a", "x")
    topics.subscribe("b", "y")
    topics.cancel("a", n)
    topics.cancel("a", n)
    assert topics.count() == 1
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "message_id string, t string")
    assert [(r.message_id, r.subscriber) for r in topics.publish(df, F.col("t")).collect()] == [("2", "y")]


def test_aggregate_golden(spark):
    lines = spark.createDataFrame([("order-1", "a", 10, 1), ("order-1", "b", 25, 2), ("order-1", "c", 15, 3), ("", "d", 1, 4), (None, "e", 1, 5)], "cid string, message_id string, price int, at int")
    good, bad = aggregate.correlated(lines, F.col("cid"))
    assert bad.count() == 2
    done = aggregate.by_completion_size(good, 3, ["at"], {"total": F.sum("price")}).collect()
    assert [(r.n_members, r.total, r.released) for r in done] == [(3, 50, True)]


def test_repeated_adds_and_missing_sizes(spark):
    df = spark.createDataFrame([("g", "a", 1, 2), ("g", "a", 2, 2), ("g", "b", 3, None), ("h", "a", 1, None)], "group_key string, message_id string, at int, sequence_size int")
    done = {r.group_key: (r.n_members, r.released) for r in aggregate.by_sequence_size(aggregate.once(df, ["at"]), ["at"], {}).collect()}
    assert done == {"g": (2, True), "h": (1, False)}


def test_exchange_takes_each_reply_once_and_notes_doubles(spark):
    ts = lambda c: F.timestamp_micros(F.col(c) * 1_000_000).cast("timestamp_ntz").alias(c)
    q = spark.createDataFrame([(1, "a", 0), (5, "a", 2), (2, "a", 5), (3, "b", 0), (4, "c", 0)], "request_id long, correlation_id string, sent_at long").select("request_id", "correlation_id", ts("sent_at"))
    p = spark.createDataFrame([(10, "a", 3), (11, "a", 4), (12, "b", 40), (13, "zz", 1)], "reply_id long, correlation_id string, replied_at long").select("reply_id", "correlation_id", ts("replied_at"))
    got = exchange.correlate(q, p)
    assert {r.request_id: (r.result, r.reply_id) for r in got.collect()} == {1: ("replied", 10), 5: ("duplicate", None), 2: ("timeout", None), 3: ("timeout", None), 4: ("timeout", None)}
    assert {r.reply_id for r in exchange.unmatched(p, got).collect()} == {11, 12, 13}


def test_headers_are_not_coerced(spark):
    df = spark.createDataFrame([({"n": "5", "s": '"5"', "f": "1.5"},)], "headers map<string,string>")
    h = F.col("headers")
    row = df.select(envelope.header_int(h, "n").alias("a"), envelope.header_int(h, "s").alias("b"), envelope.header_string(h, "s").alias("c"), envelope.header_string(h, "n").alias("d"), envelope.header_int(h, "f").alias("e"), envelope.header_int(h, "zz").alias("f")).first()
    assert tuple(row) == (5, None, "5", None, None, None)


def test_undecodable_headers_are_marked(spark):
    df = spark.createDataFrame([('{"x":1,"delivery-count":3}',), ("{bad",), ("",), (None,)], "headers_json string")
    got = envelope.decode_headers(df).collect()
    assert [r.decode_error for r in got] == [False, True, False, False]
    assert got[0].headers == {"x": "1"} and got[0].delivery_count == 3 and got[2].headers == {}


def test_replies_are_unmatched_as_in_the_sql_at_half_seconds(spark, tmp_path):
    """A delay of 2.5 s is one of 2 s in the SQL, 3.5 s one of 4 s, so which reply is first depends on the rounding."""
    at = lambda us: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=us)
    rows = [(7, at(0), 1, "view", 0.0), (8, at(0), 1, "click", 2.5), (9, at(600_000), 1, "click", 2.0)]
    rows += [(14, at(0), 1, "view", 0.0), (15, at(0), 1, "error", 3.5), (16, at(600_000), 1, "error", 3.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for q in ("reply_unmatched", "request_reply"):
        got = sorted(map(tuple, catalog.queries()[q](spark, str(tmp_path)).collect()))
        assert got == sorted(db.execute(catalog.oracle_sql()[q]).fetchall())
    assert sorted(r.reply_id for r in messages.reply_unmatched(spark, str(tmp_path)).collect()) == [9, 15]
