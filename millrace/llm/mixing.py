"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded selection.

The documents of a source follow one another in a seeded order; that stream of words is cut in blocks of
equal size, so small that the least target has ``LEAST_PER_SOURCE`` of them, down to single words. Blocks go
to sources by the highest quotients target / (2 q + 1); as the method never takes a block back when more are
dealt, the quota of an output shard is the difference of two such allocations. A source takes all its words
as often as its quota holds them, and of the rest a run of blocks (on a ring) from a seeded start, so all
documents but two of a source are taken whole.

Edge cases: a null text has no words; documents without words take none; the null source is a source of its
own, last in order; repeated rows are separate documents; an empty table gives an empty result; of other
columns ``mix`` returns none and ``mixed_documents`` all, whatever their names. Only one sum per source comes
to the driver; quotas take a few vector operations over them, however many.
"""

from __future__ import annotations

import heapq
import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stash, table, unused
from ._ordered import before

SEED = 20
BLOCK_WORDS = 256
LEAST_BLOCKS = 20_000
LEAST_PER_SOURCE = 200
SHARDS = 8
MOST_TIMES = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], most_times: int = MOST_TIMES) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; none above ``most_times`` its size, the excess reshared.

    A source stops where the share of one unit of weight exceeds its size over its weight; sources in that
    order, the first at which the rest can be shared freely ends the stopped ones.
    """
    s, w = np.array(sizes, float), np.array(weights, float)
    if not len(s) or not s.sum():
        return [0.0] * len(s)
    order = np.argsort(s / w, kind="stable")
    left = s.sum() - most_times * np.concatenate([[0.0], np.cumsum(s[order])])
    share = w.sum() - np.concatenate([[0.0], np.cumsum(w[order])])
    with np.errstate(divide="ignore", invalid="ignore"):
        per = left[:-1] / share[:-1]
    free = np.flatnonzero(per * w[order] <= most_times * s[order])
    found = most_times * s
    if len(free):
        rest = order[free[0] :]
        found[rest] = np.minimum(per[free[0]] * w[rest], most_times * s[rest])
    return found.tolist()


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2 q + 1); of equal quotients the first goes first.

    Rounding by the divisor total / seats gives the highest quotients for some number of seats near the one
    wanted: the few that are missing or too many are then dealt or taken back one by one, so time depends
    neither on ``seats`` nor on more than about half the number of sources.
    """
    v = np.array(votes, float)
    total = math.fsum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    quota = np.floor(v * (seats / total) + 0.5).astype(np.int64)
    give = [(-v[i] / (2 * quota[i] + 1), i) for i in np.flatnonzero(v > 0)]
    take = [(v[i] / (2 * quota[i] - 1), -i) for i in np.flatnonzero(quota > 0)]
    heapq.heapify(give)
    heapq.heapify(take)

    def more() -> None:
        while give[0][0] != -v[give[0][1]] / (2 * quota[give[0][1]] + 1):
            heapq.heapreplace(give, (-v[give[0][1]] / (2 * quota[give[0][1]] + 1), give[0][1]))
        _, i = give[0]
        quota[i] += 1
        heapq.heapreplace(give, (-v[i] / (2 * quota[i] + 1), i))
        heapq.heappush(take, (v[i] / (2 * quota[i] - 1), -i))

    def less() -> None:
        while quota[-take[0][1]] <= 0 or take[0][0] != v[-take[0][1]] / (2 * quota[-take[0][1]] - 1):
            heapq.heappop(take)
        _, i = heapq.heappop(take)
        quota[-i] -= 1
        heapq.heappush(give, (-v[-i] / (2 * quota[-i] + 1), -i))
        if quota[-i] > 0:
            heapq.heappush(take, (v[-i] / (2 * quota[-i] - 1), i))

    # rounding may have met a tie either way, so one more is dealt and taken back
    for _ in range(max(0, seats - int(quota.sum())) + 1):
        more()
    while quota.sum() > seats:
        less()
    return quota.tolist()


@dataclass
class Plan:
    """For each source: its words, target, quota in blocks, and the quota of each output shard."""

    source: str | None
    size: int
    target: float
    quota: int
    by_shard: list[int]
    times: int
    start: int
    stop: int


def plan(sums: dict[str | None, int], seed: int = SEED, shards: int = SHARDS) -> tuple[int, list[Plan]]:
    """The block size, and what is taken of each source: ``times`` all of it, and the run of words from
    ``start`` to ``stop`` (past the end: on from the beginning)."""
    names = sorted((s for s in sums if s is not None)) + ([None] if None in sums else [])
    sizes = [sums[s] for s in names]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
    least = min((g for g in goal if g > 0), default=0)
    block = max(1, min(BLOCK_WORDS, sum(sizes) // LEAST_BLOCKS, int(least // LEAST_PER_SOURCE)))
    seats = round(sum(sizes) / block)
    steps = [sainte_lague(goal, seats * (k + 1) // shards) for k in range(shards)]
    plans = []
    for i, name in enumerate(names):
        size, quota = sizes[i], steps[-1][i]
        # quotas count words from here on: the last block of a source may be short
        words = min(quota * block, MOST_TIMES * size)
        times, rest = divmod(words, size) if size else (0, 0)
        blocks = -(-size // block)
        start = ((seed * 2654435761 + i * 40503) % blocks) * block if blocks else 0
        by_shard = [b[i] - (a[i] if a else 0) for a, b in zip([None, *steps[:-1]], steps)]
        plans.append(Plan(name, size, goal[i], quota, by_shard, times, start, start + rest))
    return block, plans


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, th, at, source_size, target, times, cut_from, cut_to, wrap_to, shards, taken)``
    of every row of ``docs(doc_id, text, source)``: ``times`` the whole text, once more the words
    ``[cut_from, cut_to)`` and ``[0, wrap_to)``, and ``shards`` with the output shard of each pass.

    One pass over the texts counts words; then only ids and sizes are shuffled, evenly whatever the
    largest source.
    """
    return _placed(sized(docs, seed), seed)


def sized(docs: DataFrame, seed: int = SEED, row: Column | None = None) -> DataFrame:
    """Ids, sources and sizes of ``docs``, with the hash that orders a source; th tells texts apart, and so
    does ``row``, if given, with equal rows."""
    th = F.xxhash64("text")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), th))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    more = [] if row is None else [row.cast("long").alias("row")]
    return stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), h.alias("h"), th.alias("th"), *more), "mix-sizes")


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a source
    block, plans = plan({r.source: r["size"] for r in found}, seed)
    known = spark.createDataFrame(
        [(p.source, p.size, p.target, p.times, p.start, p.stop, [b * block for b in itertools.accumulate(p.by_shard)]) for p in plans],
        "_source string, source_size long, target double, times long, _start long, _stop long, _ends array<long>",
    )
    placed = before(rows, ["source"], ["h", "doc_id", "size", "th"], F.col("size"), max([r.n for r in found], default=0), "at")
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("_source")))

    def inside(low: Column, high: Column) -> tuple[Column, Column]:
        """The part of the run that falls in this document, in its own words."""
        a = F.greatest(low, F.col("at")) - F.col("at")
        b = F.least(high, F.col("at") + F.col("size")) - F.col("at")
        return a, F.greatest(a, b)

    end = F.least("_stop", "source_size")
    wrap = F.least(F.greatest(F.col("_stop") - F.col("source_size"), F.lit(0)), F.col("_start"))
    cut_from, cut_to = inside(F.col("_start"), end)
    _, wrap_to = inside(F.lit(0).cast("long"), wrap)
    placed = placed.withColumn("cut_from", cut_from).withColumn("cut_to", cut_to).withColumn("wrap_to", wrap_to)
    taken = F.col("times") * F.col("size") + F.col("cut_to") - F.col("cut_from") + F.col("wrap_to")
    # all that is taken of a source, one pass after another, fills the shards up to their quotas
    run_at = F.when(F.col("cut_to") > F.col("cut_from"), F.greatest("at", "_start") - F.col("_start")).when(F.col("wrap_to") > 0, F.col("source_size") - F.col("_start") + F.col("at"))
    passes = F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("times") - 1, F.lit(0))), lambda e: e * F.col("source_size") + F.col("at"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    places = F.concat(passes, F.array_compact(F.array(F.col("times") * F.col("source_size") + run_at)))
    shard_of = F.transform(places, lambda p: F.least(F.size(F.filter("_ends", lambda e: e <= p)), F.lit(SHARDS - 1)))
    placed = placed.withColumn("shards", F.when(taken > 0, shard_of))
    return placed.withColumn("taken", taken).drop("_source", "_start", "_stop", "_ends", "h")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken whole, and once
    more with the words of a part; documents of which nothing is taken are left out.

    Documents and what is taken of them meet by id; where ids repeat, the rows are numbered in a written
    table first, so rows that differ in other columns only keep their own.
    """
    n, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    names = docs.columns
    doc, one, row = unused(docs, "doc", "one", "row")
    key = F.col("doc_id").cast("long")
    if n != ids:
        docs, key = stash(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows"), F.col(row)
    taken = _placed(sized(docs, seed, key), seed)
    how = F.struct("times", "cut_from", "cut_to", "wrap_to", "size").alias(one)
    by = stash(taken.where("taken > 0").select(F.col("row").alias(doc), how), "mix-taken")
    rows = docs.join(by, key == F.col(doc))
    how = {c: F.col(f"{one}.{c}") for c in ("times", "cut_from", "cut_to", "wrap_to", "size")}
    cut = how["cut_to"] - how["cut_from"]
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    part = F.array_join(F.concat(F.slice(words, 1, how["wrap_to"].cast("int")), F.slice(words, (how["cut_from"] + 1).cast("int"), cut.cast("int"))), " ")
    part = F.when(cut == how["size"], F.col("text")).when(cut + how["wrap_to"] > 0, part)
    texts = F.concat(F.array_repeat("text", how["times"].cast("int")), F.array_compact(F.array(part)))
    rows = rows.withColumn(doc, F.explode(texts)).withColumn("text", F.col(doc))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.select(*[f"`{c}`" for c in names])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("shards"))
