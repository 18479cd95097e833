"""Sharding by minimax contiguous partition of ordered atomic groups (law ``bytes``).

Documents with equal texts form a group that stays together. Groups follow each other by a hash of the
text. A group larger than the mean of what is left gets a shard of its own; over the others the smallest
capacity is found for which greedy filling needs no more shards than there are, and the cuts are made there.

The search is exact but the driver never sees the groups: it works on the sums of at most a few ten thousand
cells of the hash range. Where a cut could fall inside a cell of several groups, lower and upper bounds of
the capacity follow, and only the cells in between are split by further hash bits, until every cut in
question lies between single groups.

Edge cases: a null text counts as empty and joins the empty texts' group; null or repeated ids are
separate rows with slots of their own; with fewer groups than shards some shards stay empty; an empty table
gives an empty result; other columns are kept by ``shard_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stash, table
from ._ordered import before

SHARDS = 40
FIXED_BYTES = 16
KEY_BITS, FIRST_BITS, MORE_BITS = 63, 14, 5


@dataclass
class Cells:
    """Consecutive parts of the key range: the first key of each, its depth in bits, sum and group count."""

    key: np.ndarray
    depth: np.ndarray
    size: np.ndarray
    count: np.ndarray

    def sums(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)])


def fill(cells: Cells, sums: np.ndarray, capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Ends of greedily filled shards, as sums. Where an end falls inside a cell of several groups, it is
    kept there if ``hopeful``, else moved to the cell's start."""
    at, ends = 0, []
    for _ in range(shards):
        to = min(at + capacity, int(sums[-1]))
        i = int(np.searchsorted(sums, to, "right")) - 1
        if sums[i] != to and not (hopeful and cells.count[i] > 1):
            to = max(int(sums[i]), at)
        ends.append(to)
        at = to
    return ends


def capacity_of(cells: Cells, shards: int, hopeful: bool) -> int:
    """The smallest capacity for which greedy filling reaches the end."""
    sums = cells.sums()
    total = int(sums[-1])
    low, high = -(-total // shards), max(total, 1)
    while low < high:
        mid = (low + high) // 2
        if fill(cells, sums, mid, shards, hopeful)[-1] == total:
            high = mid
        else:
            low = mid + 1
    return low


def unsure(cells: Cells, shards: int) -> tuple[np.ndarray, int]:
    """Cells of several groups in which a cut may fall, and the capacity's upper bound."""
    sums = cells.sums()
    low, high = capacity_of(cells, shards, True), capacity_of(cells, shards, False)
    early, late = fill(cells, sums, low, shards, False), fill(cells, sums, high, shards, True)
    touched = np.zeros(len(cells.key), bool)
    for a, b in zip(early, late):
        first = int(np.searchsorted(sums, a, "right")) - 1
        last = int(np.searchsorted(sums, b, "left"))
        touched[max(first, 0) : last] = True
    return np.flatnonzero(touched & (cells.count > 1)), high


def _cells(groups: DataFrame, depth: int) -> Cells:
    rows = groups.groupBy(F.shiftright("key", KEY_BITS - depth).alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("p").collect()
    p = np.array([r.p for r in rows], np.int64)
    return Cells(p << (KEY_BITS - depth), np.full(len(rows), depth), np.array([r["size"] for r in rows], np.int64), np.array([r.n for r in rows], np.int64))


def cuts(groups: DataFrame, shards: int) -> list[int]:
    """The first key of every shard but the first, for ``groups(key, size)`` in the order of unique keys."""
    cells = _cells(groups, FIRST_BITS)
    if not len(cells.key) or shards < 2:
        return []
    while True:
        split, capacity = unsure(cells, shards)
        if not len(split):
            break
        fresh = []
        for depth in np.unique(cells.depth[split]):
            depth = int(depth)
            wanted = cells.key[split[cells.depth[split] == depth]] >> (KEY_BITS - depth)
            # at most as many rows as the driver's cells
            chosen = groups.sparkSession.createDataFrame([(int(k),) for k in wanted], "p long")
            part = groups.withColumn("p", F.shiftright("key", KEY_BITS - depth)).join(chosen, "p", "left_semi")
            fresh.append(_cells(part, min(KEY_BITS, depth + MORE_BITS)))
        keep = np.ones(len(cells.key), bool)
        keep[split] = False
        parts = [Cells(cells.key[keep], cells.depth[keep], cells.size[keep], cells.count[keep]), *fresh]
        order = np.argsort(np.concatenate([c.key for c in parts]))
        cells = Cells(*(np.concatenate([getattr(c, f) for c in parts])[order] for f in ("key", "depth", "size", "count")))
    sums = cells.sums()
    ends = fill(cells, sums, capacity, shards, False)[:-1]
    at = [int(np.searchsorted(sums, e, "left")) for e in ends]
    return [int(cells.key[i]) if i < len(cells.key) else 1 << KEY_BITS for i in at]


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with size, text_crc32, law, shard, slot and grown_shard.

    Only keys and sizes are aggregated; each row then finds its shard by comparing its key with at most
    ``shards`` constants. Slots follow a hash of the id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.shiftrightunsigned(F.xxhash64(text), 1)
    rows = docs.withColumns({"size": (F.octet_length(text) + FIXED_BYTES).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "_key": key})
    rows = stash(rows.withColumn("_order", F.xxhash64("doc_id", "_key")), "shard-rows")
    # texts whose keys collide stay together too, so groups may be told apart by key alone
    groups = stash(rows.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("size")), "shard-groups")
    left, free, giants = int(groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]), shards, []
    for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        if r["size"] * free <= left or free < 2:
            break
        giants.append(r.key)
        left, free = left - r["size"], free - 1
    small = groups.where(~F.col("key").isin(giants)) if giants else groups
    first = cuts(small, free)
    shard: Column = F.lit(len(giants))
    for k in first:
        if k < 1 << KEY_BITS:
            shard = shard + (F.col("_key") >= F.lit(k)).cast("int")
    for i, k in enumerate(giants):
        shard = F.when(F.col("_key") == F.lit(k), F.lit(i)).otherwise(shard)
    placed = rows.withColumns({"law": F.lit("bytes"), "shard": shard.cast("int"), "grown_shard": F.lit(None).cast("int")})
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    return before(placed, ["shard"], ["_order", "doc_id", "size"], F.lit(1).cast("long"), most, "slot").drop("_key", "_order")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = shard_documents(docs)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
