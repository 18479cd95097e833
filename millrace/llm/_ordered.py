"""Running totals inside groups of any size, without putting a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_CELL = 256


def cells_of(most_rows: int, per_cell: int = PER_CELL) -> int:
    """The bits that cut a group of ``most_rows`` in cells of about ``per_cell``."""
    return max(0, math.ceil(math.log2(max(1, most_rows / per_cell))))


def _same(pairs: list[tuple[str, str]]) -> Column:
    found = F.lit(True)
    for a, b in pairs:
        found &= F.col(a).eqNullSafe(F.col(b))
    return found


def running_cells(cells: DataFrame, groups: list[str], cell: str, value: str, bits: int, out: str) -> DataFrame:
    """Add ``out`` to one row per ``(groups, cell)``: the sum of ``value`` over the group's earlier cells.

    Cells of ``bits`` bits are summed in two steps, inside runs of about the root of their number and along
    the runs, so no task sees all cells of a large group; few cells are summed at once.
    """
    low = bits // 2
    if low < 4:
        along = Window.partitionBy(*groups).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        return cells.withColumn(out, F.coalesce(F.sum(value).over(along), F.lit(0)))
    rows = cells.withColumn("_run", F.shiftright(cell, low))
    runs = rows.groupBy(*groups, "_run").agg(F.sum(value).alias("_run_sum"))
    along = Window.partitionBy(*groups).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(g).alias(f"_of_{g}") for g in groups], F.col("_run").alias("_of_run"), F.coalesce(F.sum("_run_sum").over(along), F.lit(0)).alias("_run_base"))
    inside = Window.partitionBy(*groups, "_run").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_run_part", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = _same([(g, f"_of_{g}") for g in groups]) & (F.col("_run") == F.col("_of_run"))
    joined = rows.join(runs, same).withColumn(out, F.col("_run_base") + F.col("_run_part"))
    return joined.drop("_run", "_of_run", "_run_base", "_run_part", *[f"_of_{g}" for g in groups])


def before(df: DataFrame, groups: list[str], order: list[str], value: Column, most_rows: int, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come earlier in ``order``.

    The first of ``order`` is a 64-bit hash, compared unsigned by its top bits; these cut each group in cells
    of about ``PER_CELL`` rows, so tasks stay even however large a group is. Totals of cells are summed along
    the group in two steps, rows inside their cell; rows of equal hash share a cell. ``df`` is read twice and
    should be a written table; ``most_rows`` is the size of the largest group. Nulls in ``groups`` are a group
    of their own.
    """
    bits = cells_of(most_rows)
    cell = F.shiftrightunsigned(order[0], 64 - bits) if bits else F.lit(0).cast("long")
    rows = df.withColumn("_cell", cell).withColumn("_value", value)
    sums = running_cells(rows.groupBy(*groups, "_cell").agg(F.sum("_value").alias("_total")), groups, "_cell", "_total", bits, "_base")
    sums = sums.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_cell").alias("_at"), "_base")
    inside = Window.partitionBy(*groups, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_part", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    joined = rows.join(sums, _same([(g, f"_{g}") for g in groups]) & (F.col("_cell") == F.col("_at"))).withColumn(out, (F.col("_base") + F.col("_part")).cast("long"))
    return joined.drop("_cell", "_value", "_part", "_base", "_at", *[f"_{g}" for g in groups])
