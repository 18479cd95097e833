"""SimHash fingerprints and near-duplicate classes by covering locality-sensitive hashing.

A fingerprint has 64 bits, voted by the hashes of word shingles. Two fingerprints link when they differ in
at most ``radius`` bits. Every pair that links shares a key in one of 2^(radius+1) - 1 tables: bit i has a
nonzero vector m(i) of radius+1 bits, table v keeps the bits with odd <m(i), v>, and whatever ``radius``
bits differ, some v is orthogonal to all their vectors, so that table drops them all.

Edge cases: a null or empty text has the fingerprint zero, linked like any other; a text of fewer words
than a shingle is one shingle; a row with a null doc_id is fingerprinted but takes no part in linking and
has a null component; repeated rows fall in one class; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stash, table, unused
from ._text import column, slices
from .components import connected
from .minima import links as similar_links
from .minima import minima

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit integer."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    n = len(ends)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536])), np.uint64)
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, sketched: bool = False) -> DataFrame:
    """``(doc_id, th, fp)`` of every row of ``docs(doc_id, text)``; th tells texts with equal ids apart.

    With ``sketched`` also the columns ``keys`` and ``sketch`` of ``minima``.
    """
    names = ["doc_id", "th", "fp"] + ["keys", "sketch"] * sketched

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            raw, offsets = column(batch, "text")
            data = raw.tobytes()
            fps = [fingerprint(data[s:e], shingle) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            more = minima(batch) if sketched else ()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), *more], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(each, "doc_id long, th long, fp long" + ", keys array<bigint>, sketch binary" * sketched)


def masks(radius: int = 4, step: int = 1) -> list[int]:
    """The bit masks of the tables, as signed 64-bit integers; ``step`` chooses the mapping of bits."""
    most = (1 << radius + 1) - 1
    found = []
    for v in range(1, most + 1):
        bits = sum(1 << i for i in range(64) if (((i * step + i // most * (step - 1)) % most + 1) & v).bit_count() & 1)
        found.append(bits - (1 << 64) if bits >> 63 else bits)
    return found


def _spread(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links, breadth first over what is not reached yet."""
    left = np.sort(fps)
    edges = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = np.bitwise_count((left ^ one).view(np.uint64)) <= radius  # of signed words it counts the absolute value
            if near.any():
                found = left[near]
                edges += [(int(one), int(x)) for x in found]
                queue.extend(found)
                left = left[~near]
    return edges


def tree(fps: np.ndarray, radius: int = 4, most: int = 4096) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints; never a list of all pairs.

    In a dense bucket each breadth-first step reaches many, so work is near-linear. A bucket of more than
    ``most`` is cut again by covering masks of another mapping, which part what is not near; what is in one
    component already is skipped. Memory is that of the fingerprints and of a forest.
    """
    if len(fps) <= most:
        return _spread(fps, radius)
    fps = np.unique(fps)
    root = np.arange(len(fps))
    edges = []

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for mask in masks(radius, 7):
        order = np.argsort(fps & mask, kind="stable")
        keys = (fps & mask)[order]
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for i in np.flatnonzero(np.diff(bounds) > 1):
            some = order[bounds[i] : bounds[i + 1]]
            if (root[some] == root[some[0]]).all():
                continue
            for a, b in _spread(fps[some], radius):
                x, y = find(int(np.searchsorted(fps, a))), find(int(np.searchsorted(fps, b)))
                if x != y:
                    edges.append((a, b))
                    root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root = root[root]
    return edges


def _bucket_links(radius: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by table and key; a bucket may go on in the next batch."""
        rest = np.zeros((3, 0), np.int64)

        def links(rows: np.ndarray) -> list[tuple[int, int]]:
            cut = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            bounds = np.concatenate([[0], cut, [rows.shape[1]]])
            out = []
            for i in np.flatnonzero(np.diff(bounds) > 1):
                out += tree(rows[2, bounds[i] : bounds[i + 1]], radius)
            return out

        def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = (list(x) for x in zip(*edges)) if edges else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            rows = np.vstack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = np.hstack([rest, rows])
            if not rows.shape[1]:
                continue
            last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            at = rows.shape[1] - int(np.argmin(last[::-1])) if not last.all() else 0
            rest = rows[:, at:]
            if at:
                yield batch_of(links(rows[:, :at]))
        if rest.shape[1]:
            yield batch_of(links(rest))

    return each


def links(reps: DataFrame, radius: int = 4) -> DataFrame:
    """Links that join what is linked: ``(a, b)`` among the distinct fingerprints of ``reps(fp)``."""
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])
    rows = reps.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    # several rows of a table share a key only by chance or because they are near
    dealt = rows.repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(_bucket_links(radius), "a long, b long").distinct()


def _rooted(docs: DataFrame, radius: int, shingle: int, similarity: float | None = None) -> DataFrame:
    """``(doc_id, th, fp, root, component_id)`` per row; root is the fingerprint that names the class.

    Equal fingerprints are one node from the start, so a group of copies of any size costs one row. With
    ``similarity`` the links of ``minima`` join fingerprints too.
    """
    fps = stash(fingerprints(docs, shingle, similarity is not None), "simhash")
    reps = stash(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-reps")
    found = links(reps, radius)
    if similarity is not None:
        found = found.unionByName(similar_links(fps.where("doc_id is not null"), similarity))
    roots = connected(found)
    named = stash(reps.join(roots, reps.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = stash(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    of_fp = stash(named.join(least, "root").select("fp", "root", "component_id"), "simhash-of")
    return fps.join(of_fp, "fp", "left").select("doc_id", "th", "fp", "root", "component_id")


def near_classes(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """``(doc_id, th, fp, component_id)`` per row: the smallest doc_id reachable over links."""
    rows = _rooted(docs, radius, shingle)
    return rows.select("doc_id", "th", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, radius: int = 4, shingle: int = 4, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns kept, that stand for their class: the smallest doc_id.

    Rows without a doc_id all stay. Of every class one row stays, also where ids are repeated: classes are
    told apart by their root, not by an id that two of them may share. With ``similarity`` texts link as well
    whose sets of five-word shingles are estimated to be that similar, see ``minima``.
    """
    rows = _rooted(docs, radius, shingle, similarity).where("doc_id is not null")
    doc, of = unused(docs, "doc", "th")
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("one"))
    first = stash(first.select(F.col("one.doc_id").alias(doc), F.col("one.th").alias(of)), "simhash-first")
    ids = docs.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    known = docs.where("doc_id is not null")
    kept = known.join(first, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(of)), "left_semi")
    if ids[0] != ids[1]:
        # a row of the same id and text is in the same class
        kept = kept.withColumn(of, F.xxhash64("text")).dropDuplicates(["doc_id", of]).drop(of)
    return kept.unionByName(docs.where("doc_id is null"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
