import json

import pytest
from pyspark.sql import functions as F

from millrace.plans import base, catalog
from millrace.sources import spool, tables
from millrace.streaming import aggregator, sinks


def test_spool_is_polled_in_parts(spark, tmp_path):
    spool.register(spark)
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"message_id": str(i), "correlation_id": "c", "ts": None, "headers": {"k": i}, "payload": "p"}) for i in range(7)]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    sizes = []
    stream = spark.readStream.format("spool").option("path", str(tmp_path / "in")).option("maxPerPoll", 3).load()
    q = stream.writeStream.foreachBatch(lambda df, _: sizes.append(df.count())).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [n for n in sizes if n] == [3, 3, 1]
    with pytest.raises(spool.UnsupportedSourceError):
        spool.source_of("nothing")


def test_incomplete_groups_expire(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(3).select(F.lit("g").alias("group_key"), F.col("id").cast("string").alias("message_id"), F.col("id").alias("place"), F.lit(0).alias("size_"), F.lit(1.0).alias("value")).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("group_key string, message_id string, place long, size_ int, value double").parquet(str(tmp_path / "in"))
    rows = []
    with aggregator.rocksdb(spark):
        q = aggregator.aggregate_stream(stream, 2, 300).writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        for _ in range(100):
            if len(rows) > 1 or q.awaitTermination(0.3):
                break
        q.stop()
    assert [(r.batch, r.n_members, r.fate) for r in rows] == [(0, 2, "output"), (1, 1, "expired")]


def test_repeated_batches_write_once(spark, tmp_path):
    from millrace.operators.settle import Backoff, RetryPolicy

    spark.range(10).write.parquet(str(tmp_path / "in"))
    for attempt in range(2):
        # a new checkpoint replays batch 0, as after a failure before the commit
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        error = lambda: F.when(F.col("id") % 2 == 0, "permanent")
        sinks.settle_stream(stream, lambda b: b, error, lambda: F.lit(1), RetryPolicy(Backoff(1)), str(tmp_path / "out"), str(tmp_path / f"cp{attempt}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "ack")).count() == 5
    assert spark.read.parquet(str(tmp_path / "out" / "invalid")).count() == 5


def test_storage_tables(spark):
    with pytest.raises(ValueError):
        tables.ddl("queue", "a b")
    with pytest.raises(tables.SchemaNotReadyError):
        tables.ready(spark, "queue", "nothing_here")
    assert "lease_epoch" in tables.ddl("queue", "q")


def test_catalog_has_sql_for_every_query():
    assert set(catalog.queries()) == set(base.QUERIES)
    assert set(base.QUERIES) == set(catalog.oracle_sql())
