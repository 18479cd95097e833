"""Cells of time: running totals per key without putting a key in one task.

A key of many rows is cut in cells of time. What a later cell has to know of the earlier ones is one number a
cell, summed (or maximised) along the key; rows are then only sorted inside their cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task sorts at most, if they are spread evenly in time.
PER_CELL = 100_000


def cell_width(df: DataFrame, key: str, at_us: str, per_cell: int | None = None) -> int | None:
    """The microseconds of a cell, or None if no key has more rows than one cell may hold."""
    n = df.groupBy(key).agg(F.count("*").alias("n"), F.min(at_us).alias("a"), F.max(at_us).alias("b"))
    n = n.agg(F.max("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).first()
    cells = math.ceil((n.n or 0) / (per_cell or PER_CELL))
    return max(1, -(-(n.b - n.a + 1) // cells)) if cells > 1 else None


def with_cell(df: DataFrame, at_us: str, width: int, name: str = "_cell") -> DataFrame:
    return df.withColumn(name, F.floor(F.col(at_us) / F.lit(width)).cast("long"))


def join_cells(rows: DataFrame, cells: DataFrame, key: str, added: list[str]) -> DataFrame:
    """The rows with what ``cells(key, _cell, ...)`` say of theirs; null keys are a key of their own."""
    c = cells.select(F.col(key).alias("_of"), F.col("_cell").alias("_at"), *added)
    return rows.join(c, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_cell") == F.col("_at"))).drop("_of", "_at")


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))
