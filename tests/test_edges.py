import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import codecs
from millrace.operators import aggregate, cells, flow, flowctl, handlers, queue, settle
from millrace.plans import delivery, edges
from millrace.sources import cron, memory, spool, tables
from millrace.streaming import sinks


def test_cells_change_nothing(spark, sf_dir, monkeypatch):
    plain = {q: sorted(map(tuple, getattr(delivery, q)(spark, sf_dir).collect())) for q in ("token_bucket", "credit_inflight")}
    monkeypatch.setattr(cells, "PER_CELL", 7)
    for q, want in plain.items():
        df = getattr(delivery, q)(spark, sf_dir)
        assert "_cell" in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, df.collect())) == want


def test_a_hot_source_is_cut(spark, monkeypatch):
    monkeypatch.setattr(cells, "PER_CELL", 100)
    df = spark.range(2000).select(F.when(F.col("id") % 10 < 9, "hot").alias("s"), (F.col("id") * 1000).alias("at"), "id")
    got = [r.release_us for r in flowctl.token_bucket(df, "s", "at", ["at", "id"], 500.0, 3).where("s is null").orderBy("at").collect()]
    want, free = [], []
    for i, t in enumerate(range(9000, 2_000_000, 10_000)):
        want.append(max([t] + [f + (i - 2) * 2000 for f in free]))
        free.append(t - i * 2000)
    assert got == want


def test_terminal_steps(spark):
    df = spark.range(4).select(F.col("id").cast("string").alias("message_id"))
    seen = []
    out = flow.chain(flow.filter_(F.col("message_id") > "1", "low"), flow.to(lambda x: seen.append(x.count())), flow.consume(lambda x: seen.append(x.count())))(df)
    flow.deliver(out)
    assert seen == [2, 0] and out.main.count() == 0
    with pytest.raises(flow.NoSinkError):
        flow.deliver(flow.chain(flow.to(None))(df))
    with pytest.raises(flow.NoFunctionError):
        flow.consume(None)


def test_constructors_are_checked(spark):
    df = spark.createDataFrame([({"a": "1"}, (1,))], "headers map<string,string>, payload struct<v:int>")
    fine = {"folds": {}, "output": "out"}
    aggregate.Aggregator(**fine, completion_size=3, timeout_us=5, expired="late", correlation_expr='payload.v > 1 ? "a" : "b"', release_expr="len(messages) >= size", schema=df)
    for more in ({"folds": None}, {"output": ""}, {"timeout_us": 5}, {"completion_size": -1}):
        with pytest.raises(aggregate.AggregatorError):
            aggregate.Aggregator(**(fine | more))
    for more in ({"correlation_expr": "payload.v"}, {"release_expr": "size"}, {"release_expr": "nope("}, {"output": "", "release_expr": ""}):
        with pytest.raises(ValueError, match=".") as e:
            aggregate.Aggregator(**(fine | more), schema=df)
        assert not isinstance(e.value, aggregate.AggregatorError)
    with pytest.raises(codecs.UnexpectedCodecError):
        codecs.resolve(True, codecs.Bytes(), "string")
    assert codecs.resolve(True, None, "string") is None and codecs.resolve(False, None, "string") == codecs.Json("string")
    with pytest.raises(flow.NoFunctionError):
        handlers.handled(df, None, "int")
    with pytest.raises(cron.InvalidScheduleError):
        cron.messages(df, None, "s")
    with pytest.raises(ValueError):
        queue.QueueChannel(spark, "")


def test_schedules_of_days_and_durations():
    assert cron.parse("@every 1.5h").every == 5400 and cron.parse("@every 1500ms").every == 1 and cron.parse("@every 10ms").every == 1 and cron.parse("@every 1m0.9s").every == 60
    assert [cron.parse(s).either_day for s in ("0 0 */2 * 1", "0 0 */1 * 1", "0 0 * * 1", "0 0 1-31/2 * 1", "0 0 ?/3 * 1", "0 0 5,* * 1")] == [True, False, False, True, True, False]


def test_a_key_begins_a_group_anew(spark):
    rows = [("g", i, f"m{i}", 3) for i in range(5)] + [("g", 5, "m3", 3), ("g", 6, "m6", 1), ("g", 7, "m7", 1), ("h", 0, "a", 0), ("h", 1, "a", 2), ("h", 2, "a", 2), ("h", 3, "b", 9), ("i", 0, "z", None)]
    df = spark.createDataFrame(rows, "group_key string, at int, message_id string, sequence_size int")
    got = sorted((r.group_key, r.batch, r.n_members, r.expected, r.released) for r in aggregate.by_sequence_size(df, ["at"], {}, message_id="message_id").collect())
    assert got == [("g", 0, 3, 3, True), ("g", 1, 3, 3, True), ("g", 2, 1, 1, True), ("h", 0, 1, 0, True), ("h", 1, 2, 2, True), ("i", 0, 1, None, False)]


def test_blocked_offers_are_taken_when_there_is_room(spark):
    log = [("offer", i) for i in range(4)] + [("settle", 9), ("settle", 0), ("settle", 2), ("settle", 3), ("settle", 1)]
    df = spark.createDataFrame([("q", n, c, i) for n, (c, i) in enumerate(log)], "q string, n int, command string, id long")
    got = [(r.status, r.depth) for r in queue.bounded_queue(df, 2, "block", ["n"], "q").orderBy("n").collect()]
    assert got == [("accepted", 1), ("accepted", 2), ("blocked", 2), ("blocked", 2), ("unknown", 2), ("settled", 2), ("settled", 2), ("settled", 1), ("settled", 0)]


def test_spool_reads_no_byte_twice(tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps({"message_id": f"{k}.{i}"}) + "\n" for i in range(5)) + ("" if k else "no json\n\n"))
    with (tmp_path / "2.jsonl").open("a") as f:
        f.write('{"message_id": "cut')
    reader, at, seen = spool.SpoolReader(str(tmp_path), 4), None, []
    at = reader.initialOffset()
    while True:
        rows, end = reader.read(at)
        rows = list(rows)
        assert len(rows) <= 4 and list(reader.readBetweenOffsets(at, end)) == rows
        if not rows:
            break
        seen, at = seen + rows, end
    assert [r[0] for r in seen] == [*(f"0.{i}" for i in range(5)), None, *(f"{k}.{i}" for k in (1, 2) for i in range(5))]
    assert seen[5][4] == "no json"


def test_broker_is_bounded(spark):
    broker = memory.Broker(capacity=3)
    with pytest.raises(memory.FullError):
        broker.send(spark.range(10).select(F.col("id").cast("string").alias("message_id"), F.lit("c").alias("correlation_id"), F.lit("p").alias("payload")))
    assert len(broker) == 0


def test_a_query_stops_between_batches(spark, tmp_path):
    stream = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path)).trigger(processingTime="200 milliseconds").start()
    assert sinks.stop_gracefully(q, 20) and not q.isActive


def test_tables_are_made_and_checked(spark, tmp_path):
    name = "inbox_of_a_test"
    with pytest.raises(tables.SchemaNotReadyError):
        tables.ready(spark, "inbox", name)
    spark.sql(f"{tables.ddl('inbox', name)} LOCATION '{tmp_path}/inbox'")
    try:
        tables.ensure(spark, "inbox", name)
        spark.sql(f"insert into {name} values ('a', null), ('b', null)")
        tables.ready(spark, "inbox", name)
        with pytest.raises(tables.SchemaNotReadyError):
            tables.ready(spark, "queue", name)
        spark.sql(f"insert into {name} values ('a', null)")
        with pytest.raises(tables.SchemaNotReadyError):
            tables.ready(spark, "inbox", name)
    finally:
        spark.sql(f"drop table {name}")


def test_refused_diverts_keep_their_message(spark):
    policy = settle.RetryPolicy(settle.Backoff(2.0), 2, True)
    df = spark.range(4).withColumn("err", F.when(F.col("id") > 0, "permanent"))
    done = settle.divert(settle.settle(df, F.col("err"), F.lit(1), policy), F.col("id") == 2, F.lit(1), policy).orderBy("id").collect()
    assert [(r.outcome, r.delay, r.diverted) for r in done] == [("ack", None, False), ("invalid", None, True), ("retry", 2.0, False), ("invalid", None, True)]


def test_edges_are_registered():
    assert {"to_sink", "outbox_stream", "divert_refused"} <= set(vars(edges))
