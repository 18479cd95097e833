"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

The model is fitted on the driver on a bounded sample of labelled rows (``max_rows``, by hash of the id,
outside the held-out fold) and travels with the tasks; every document is scored in one pass without a
shuffle. Labels, language, source and id are never inputs.

Edge cases: a null or empty text has zero statistics and is scored as such; a null label or id is not
learned from; of repeated labels the larger counts; no labels at all give 0.5 to every text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from ._common import held_out, table
from ._text import SPACE, column, hash_runs, mix, runs, slices

MAX_ROWS = 20_000
THRESHOLD = 0.3


def _class(*spans: tuple[int, int]) -> np.ndarray:
    found = np.zeros(256, bool)
    for low, high in spans:
        found[low : high + 1] = True
    return found


CLASSES = (
    _class((48, 57)),
    _class((65, 90)),
    _class((46, 46), (33, 33), (63, 63)),
    _class((44, 44), (58, 59)),
    _class((34, 43), (45, 45), (47, 47), (60, 62), (64, 64), (91, 96), (123, 123), (125, 126)),
    _class((124, 124)),
    _class((10, 10)),
    _class((128, 255)),
)
SYMBOL = _class((33, 43), (45, 45), (47, 47), (58, 64), (91, 96), (123, 126))


def statistics(batch: pa.RecordBatch) -> np.ndarray:
    """A row of numbers for each text of the batch."""
    raw, offsets = column(batch, "text")
    n = batch.num_rows
    size = np.diff(offsets)
    starts, ends, row = runs(~SPACE[raw], offsets)
    lens = (ends - starts).astype(float)
    words = np.bincount(row, minlength=n)
    per_word = np.maximum(words, 1)
    h = hash_runs(raw, starts, ends)
    key, first, count = np.unique(mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    of = row[first]
    mean = np.bincount(row, lens, n) / per_word
    same = np.zeros(len(row), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])

    def share(which: np.ndarray) -> np.ndarray:
        return np.bincount(row[which], minlength=n) / per_word

    found = [
        np.log1p(words),
        np.log1p(size),
        mean,
        np.sqrt(np.maximum(np.bincount(row, lens**2, n) / per_word - mean**2, 0)),
        np.bincount(of, minlength=n) / per_word,
        np.bincount(of, count.astype(float) ** 2, n) / per_word**2,
        share(same),
        share(lens <= 3),
        share(lens >= 20),
        share(lens == 1),
        share(SYMBOL[raw[ends - 1]] if len(ends) else np.zeros(0, bool)),
        share(CLASSES[1][raw[starts]] if len(starts) else np.zeros(0, bool)),
    ]
    per_byte = np.maximum(size, 1)
    for one in CLASSES:
        sums = np.concatenate([[0], np.cumsum(one[raw])])
        found.append((sums[offsets[1:]] - sums[offsets[:-1]]) / per_byte)
    return np.column_stack(found)


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            x = statistics(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])


def sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``(doc_id, y)`` of at most ``max_rows`` labelled ids outside the held-out fold, by hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    once = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> boosting.Forest:
    """Fit on a bounded sample; only its statistics come to the driver."""
    chosen = F.broadcast(sample(labels, "quality", max_rows))  # max_rows rows of two numbers at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(chosen, "doc_id", "left_semi").mapInArrow(_statistics_rows, "doc_id long, x array<double>")
    got = rows.groupBy("doc_id").agg(F.min("x").alias("x")).join(chosen, "doc_id").orderBy("doc_id").toPandas()
    if not len(got):
        return boosting.fit(np.zeros((0, 1)), np.zeros(0))
    return boosting.fit(np.array(got.x.tolist()), got.y.to_numpy(float))


def score(docs: DataFrame, model: boosting.Forest) -> DataFrame:
    """``(doc_id, score)`` of every text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                p = model.predict(statistics(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, score double")


def keep_good(docs: DataFrame, model: boosting.Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text reaches the threshold. One pass, no shuffle."""
    schema = docs.schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield batch.filter(pa.array(model.predict(statistics(batch)) >= threshold))

    return docs.mapInArrow(each, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
