"""Links between texts whose sets of five-word shingles are similar, for the near-duplicate stage.

Fingerprints of pairs with a Jaccard similarity of 0.8 typically differ in 8 to 12 bits, beyond what a covering
can guarantee, so the stage adds these links to those of the covering. A text has ``MINIMA`` minima of its
shingles under as many hash functions. Texts that share a band, ``ROWS`` minima in a row of the first
``BANDS * ROWS``, meet in a bucket (at 0.8 one pair in 200 shares none), and link when their minima agree, by
eight bits of each, as often as those of sets of the similarity do: an estimate with a standard error of 0.018.

A bucket of more than ``LARGE`` texts is settled in two steps, and no pair of it is left out. First it is told
apart by the next band too, and what is still larger is dealt in parts of about that size: texts of a large group
of copies meet in many parts by the other bands, and one class comes out of it. Then every text of the bucket
outside its largest class is compared with all texts of the bucket that are not in its class yet, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stash
from ._text import SPACE, column, hash_runs, mix, runs
from .components import connected

SHINGLE = 5
BANDS, ROWS = 10, 4
MINIMA = 512
LARGE = 2048
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(batch: pa.RecordBatch, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of every text one after another, and where each text's begin.

    A text of fewer words is one shingle, one without words has that of no words.
    """
    raw, offsets = column(batch, "text")
    raw = _LOWER[raw]
    starts, ends, row = runs(~SPACE[raw], offsets)
    words = np.append(hash_runs(raw, starts, ends), np.uint64(0))
    n = np.bincount(row, minlength=batch.num_rows)
    first = np.cumsum(n) - n
    count = np.maximum(n - shingle + 1, 1)
    begin = np.cumsum(count) - count
    of = np.repeat(np.arange(batch.num_rows), count)
    at = first[of] + np.arange(len(of)) - begin[of]
    left = n[of]
    g = np.minimum(left, shingle).astype(np.uint64)
    for k in range(shingle):
        g = np.where(k < left, mix(g * _STEP + words[np.minimum(at + k, len(words) - 1)]), g)
    return g, begin


def minima(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """Of every text the keys of its bands, and eight bits of each of its minima."""
    g, begin = shingles(batch)
    n = len(begin)
    least = mix(np.stack([np.minimum.reduceat(g * m, begin) for m in _MULTIPLIERS], 1))
    rows = least[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS))
    for k in range(ROWS):
        key = mix(key * _STEP + rows[:, :, k])
    keys = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, np.ascontiguousarray(key).reshape(-1).view(np.int64))
    low = np.ascontiguousarray(least.astype(np.uint8))
    sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(MINIMA), n, [None, pa.py_buffer(low.tobytes())]).cast(pa.binary())
    return keys, sketch


def agreeing(similarity: float) -> int:
    """How many minima of sets so similar agree in eight bits, chance agreement included."""
    return int(np.ceil(MINIMA * (similarity + (1 - similarity) / 256)))


def agreement(sketch: np.ndarray, one: np.ndarray) -> np.ndarray:
    """With how many minima of ``one`` each row agrees; sums of eight bytes at once stay below 256 each."""
    by_byte = (sketch == one).view(np.uint64).sum(1, dtype=np.uint64)
    return by_byte.view(np.uint8).reshape(-1, 8).sum(1, dtype=np.int64)


def forest(fps: np.ndarray, sketch: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in a bucket, breadth first over what is not reached yet."""
    need, edges = agreeing(similarity), []
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            like = agreement(sketch[left], sketch[one]) >= need
            if like.any():
                found = left[like]
                edges += [(int(fps[one]), int(fps[x])) for x in found if fps[x] != fps[one]]
                queue.extend(found)
                left = left[~like]
    return edges


def bridges(fps: np.ndarray, root: np.ndarray, rest: np.ndarray, sketch: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges that join the classes ``root`` wherever a text with ``rest`` links to one without."""
    need, edges = agreeing(similarity), []
    of = np.unique(root, return_inverse=True)[1]
    others = np.flatnonzero(~rest)
    against = sketch[others]
    for one in np.flatnonzero(rest):
        if (of[others] == of[one]).all():
            continue
        for x in others[agreement(against, sketch[one]) >= need]:
            if of[x] != of[one]:
                edges.append((int(fps[one]), int(fps[x])))
                of[of == of[x]] = of[one]
    return edges


def _bucket_links(edges_of: Callable[..., list[tuple[int, int]]]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``(key, ..., sketch)`` come sorted by key; a bucket may go on in the next batch."""
        kept = None

        def links_of(key: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            edges = []
            for i in np.flatnonzero(np.diff(bounds) > 1):
                edges += edges_of(*(c[bounds[i] : bounds[i + 1]] for c in columns))
            a, b = (list(x) for x in zip(*edges)) if edges else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.columns[-1].to_pylist()), np.uint8).reshape(-1, MINIMA)
            rows = (*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]), sketch)
            if kept is not None:
                rows = tuple(np.concatenate([x, y]) for x, y in zip(kept, rows))
            at = int(np.searchsorted(rows[0], rows[0][-1]))
            kept = tuple(x[at:] for x in rows)
            if at:
                yield links_of(*(x[:at] for x in rows))
        if kept is not None:
            yield links_of(*kept)

    return each


def _between(wide: DataFrame, texts: DataFrame, found: DataFrame, similarity: float, large: int) -> DataFrame:
    """The links that ``found`` lacks to join what is linked within the buckets ``wide(fp, name, key)``.

    A bucket of one class is done. Of any other the texts outside its largest class, in blocks of about ``large``,
    meet all its texts, in such blocks too: of m texts with r outside 2 r m / large rows travel, m where r is small.
    """
    roots = connected(found)
    wide = wide.join(roots, wide.fp == roots.node, "left").select("fp", "name", "key", F.coalesce("root", "fp").alias("root"))
    wide = stash(wide, "minima-wide")
    classes = wide.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_ = classes.groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "root")).alias("most")).where("m > most.n")
    blocks = lambda n: F.ceil(n / large).cast("int")
    open_ = open_.select("key", F.col("most.root").alias("main"), blocks(F.col("m")).alias("n_all"), blocks(F.col("m") - F.col("most.n")).alias("n_rest"))
    rows = wide.join(stash(open_, "minima-open"), "key")
    block = lambda n: F.pmod(F.xxhash64("fp", "name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = rows.where("root <> main").select("fp", "name", "key", "root", F.lit(True).alias("rest"), block("n_rest").alias("i"), every("n_all").alias("j"))
    whole = rows.select("fp", "name", "key", "root", F.lit(False).alias("rest"), every("n_rest").alias("i"), block("n_all").alias("j"))
    met = rest.unionByName(whole).select("fp", "name", F.xxhash64("key", "i", "j").alias("key"), "root", "rest")
    full = met.join(texts.select("fp", "name", "sketch"), ["fp", "name"]).select("key", "fp", "root", "rest", "sketch")
    full = full.repartition("key").sortWithinPartitions("key")
    return full.mapInArrow(_bucket_links(lambda *columns: bridges(*columns, similarity)), "a long, b long").distinct()


def links(rows: DataFrame, similarity: float, large: int = LARGE) -> DataFrame:
    """Links ``(a, b)`` that join the fingerprints of similar texts of ``rows(fp, keys, sketch)``.

    Equal rows are one from the first aggregation on; sketches travel only to buckets of several fingerprints.
    ``large`` sets how a bucket is worked on, not what is found in it.
    """
    rows = rows.select("fp", F.xxhash64("sketch").alias("name"), "keys", "sketch")
    texts = rows.groupBy("fp", "name").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    texts = stash(texts, "minima-texts")

    def counted(dealt: DataFrame) -> DataFrame:
        """The keys that more than one fingerprint has, with their rows counted."""
        found = dealt.groupBy("key").agg(F.count("*").alias("m"), F.min("fp").alias("low"), F.max("fp").alias("high"))
        return found.where("low < high").select("key", "m")

    following = F.concat(F.slice("keys", 2, BANDS - 1), F.slice("keys", 1, 1))
    dealt = texts.select("fp", "name", F.inline(F.arrays_zip(F.col("keys").alias("key"), following.alias("other"))))
    dealt = stash(dealt.join(counted(dealt), "key"), "minima-bands")
    once = dealt.where(F.col("m") <= large).select("fp", "name", "key")
    twice = dealt.where(F.col("m") > large).select("fp", "name", F.xxhash64("key", "other").alias("key"))
    twice = twice.join(counted(twice), "key")
    part = F.pmod(F.xxhash64("name", "key"), F.ceil(F.col("m") / large))
    twice = twice.select("fp", "name", F.when(F.col("m") > large, F.xxhash64("key", part)).otherwise(F.col("key")).alias("key"))
    full = once.unionByName(twice).join(texts.select("fp", "name", "sketch"), ["fp", "name"]).select("key", "fp", "sketch")
    full = full.repartition("key").sortWithinPartitions("key")
    found = full.mapInArrow(_bucket_links(lambda fps, sketch: forest(fps, sketch, similarity)), "a long, b long").distinct()
    wide = dealt.where(F.col("m") > large).select("fp", "name", "key")
    if not wide.head(1):
        return found
    found = stash(found, "minima-links")
    return found.unionByName(_between(wide, texts, found, similarity, large))
