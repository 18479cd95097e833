"""Storage tables of queues, inboxes, groups and schedules: DDL, readiness, JDBC peers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "queue": "id bigint, msg_id string, headers string, payload binary, locked_by string, locked_at timestamp, visible_after timestamp, delivery_count int, lease_epoch bigint, created_at timestamp",
    "inbox": "msg_id string, processed_at timestamp",
    "group": "group_key string, created_at bigint, epoch bigint, locked_by string, locked_at bigint",
    "group_member": "group_key string, msg_id string, seq bigint, headers binary, payload binary, claimed_epoch bigint",
    "cron_fired": "scope string, fire_ts timestamp, claimed_at timestamp",
    "cron_leader": "scope string, holder string, expires_at timestamp",
}


class SchemaNotReadyError(RuntimeError):
    """A table that is missing or lacks columns."""


def ddl(kind: str, name: str) -> str:
    """The statement that makes a table of this kind."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} is no identifier")
    return f"CREATE TABLE IF NOT EXISTS `{name}` ({TABLES[kind]}) USING parquet"


def ensure(spark: SparkSession, kind: str, name: str) -> None:
    spark.sql(ddl(kind, name))


def ready(spark: SparkSession, kind: str, name: str) -> None:
    """Raise unless the table is there with all its columns; an inbox must have unique ids."""
    if not spark.catalog.tableExists(name):
        raise SchemaNotReadyError(f"{name} doesn't exist")
    df = spark.table(name)
    wanted = {c.split()[0] for c in TABLES[kind].split(", ")}
    if missing := wanted - set(df.columns):
        raise SchemaNotReadyError(f"{name} lacks {sorted(missing)}")
    if kind == "inbox" and df.groupBy("msg_id").count().where("count > 1").take(1):
        raise SchemaNotReadyError(f"{name} has repeated ids")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational peer; filters and columns are pushed to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def append_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a table of a relational peer, as an outbox does."""
    df.write.format("jdbc").mode("append").options(url=url, dbtable=table, **options).save()
