"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.settle import Backoff, RetryPolicy
from millrace.streaming import aggregator, sinks

from .base import query, read
from .delivery import ERROR_SQL, event_error
from .messages import BATCHED


def _folder(spark: SparkSession, name: str) -> str:
    """A folder shared with the executors; a temporary one only where the session names none."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="millrace-stream-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        top = "file://" + local
    return f"{top.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query(BATCHED.replace("cast(round(value * 100, 0) as bigint) as cents", "value as cents").replace("cast(sum(cents) as bigint) as cents", "round(sum(cents), 4) as total").replace("ts, event_id) - 1", "event_id) - 1") + "select group_key, batch, n_members, total from done where n_members >= 5")
def stream_completion_size(spark: SparkSession, d: str) -> DataFrame:
    """Groups of five in the order of ids, from keyed state."""
    stream = _events(spark, d).select(F.col("user_id").cast("string").alias("group_key"), F.col("event_id").cast("string").alias("message_id"), F.col("event_id").alias("place"), F.lit(0).alias("size_"), "value")
    at = _folder(spark, "completion")
    with aggregator.rocksdb(spark):
        sinks.drain(aggregator.aggregate_stream(stream, 5), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("group_key", "batch", "n_members", F.round("total", 4).alias("total"))


@query(f"""with a as (select event_id, {ERROR_SQL} as err from events)
select case when err is null then 'ack' when err = 'permanent' then 'invalid' when event_id % 3 = 2 then 'dead_letter' else 'retry' end as outcome, count(*) as n from a group by 1""")
def stream_settlement(spark: SparkSession, d: str) -> DataFrame:
    """Every outcome of a stream in its own folder."""
    at = _folder(spark, "settle")
    policy = RetryPolicy(Backoff(1.0), 3, True)
    q = sinks.settle_stream(_events(spark, d), lambda b: b, event_error, lambda: (F.col("event_id") % 3 + 1).cast("int"), policy, f"{at}/out", f"{at}/state")
    q.awaitTermination()
    parts = [spark.read.option("basePath", f"{at}/out/{o}").parquet(f"{at}/out/{o}").select("outcome", "event_id") for o in sinks.OUTCOMES]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("outcome").agg(F.count("*").alias("n"))


@query("select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by all")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first message of each id, ids being remembered for long."""
    at = _folder(spark, "dedup")
    stream = _events(spark, d).withColumn("at", F.col("ts").cast("timestamp")).withColumn("message_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    sinks.drain(sinks.dedup_stream(stream, "message_id", "at", "36500 days"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
