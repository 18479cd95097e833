"""The flagship flow: orders are filtered, split in their lines, transformed, put together again and routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregate, flow

from .base import query, read

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def order_messages(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """Orders as messages whose payload is the array of their lines in a fixed order; with ``status`` lines of
    other orders are dropped before they are collected."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    if status is not None:
        wanted = orders.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("l_orderkey"))
        lines = lines.join(wanted, "l_orderkey", "left_semi")
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER))).alias("payload"))
    orders = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("message_id"), F.lit(None).cast("string").alias("correlation_id"),
        F.lit(None).cast("int").alias("sequence_number"), F.lit(None).cast("int").alias("sequence_size"), F.col("o_orderstatus").alias("status"), "payload",
    )



def _cents() -> Column:
    return F.round(F.col("payload.l_extendedprice") * 100, 0).cast("decimal(18,0)")


ORDER_SQL = """
with line as (
  select l.*, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as n,
         count(*) over (partition by l_orderkey) as total
  from lineitem l join orders o on o_orderkey = l_orderkey where o_orderstatus = 'F'
)
"""


@query(
    ORDER_SQL
    + """
, totals as (
  select l_orderkey, count(*) as n_lines, sum(cast(round(l_extendedprice * 100, 0) as decimal(18,0))) as cents from line group by l_orderkey
)
select case when cents >= 30000000 then 'large' when cents >= 10000000 then 'medium' else 'small' end as channel,
       count(*) as n_orders, cast(sum(n_lines) as bigint) as n_lines, cast(sum(cents) as bigint) as cents
from totals group by 1
"""
)
def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, split with sequence stamps, transform, aggregate by sequence size, route, count."""
    steps = flow.chain(flow.filter_(F.col("status") == "F", "discarded"), flow.split(F.col("payload")), flow.transform(_cents()))
    children, _ = aggregate.correlated(steps(order_messages(spark, sf_dir, "F")).main, F.col("correlation_id"))
    groups = aggregate.whole_groups(children, ["sequence_number"], {"cents": F.sum("payload")}).where("released")
    channel = F.when(F.col("cents") >= 30000000, "large").when(F.col("cents") >= 10000000, "medium").otherwise("small")
    return groups.groupBy(channel.alias("channel")).agg(F.count("*").alias("n_orders"), F.sum("n_members").alias("n_lines"), F.sum("cents").cast("bigint").alias("cents"))
