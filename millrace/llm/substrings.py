"""Removal of repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of a document. Its minimiser is the leftmost of its ``GRAM``-word
grams with the least hash; consecutive windows with one minimiser form a super-k-mer and travel together.
Buckets are minimisers. A first pass tells which minimisers occur in several documents; the super-k-mers of
all others are unique and go no further. Where all super-k-mers of a bucket are one string, that string's
first document settles its windows. Else the distinct strings of the bucket travel, each once, as packed
text to the bucket, and sorting their windows finds the first document of each. A bucket with very many
distinct strings (a frequent passage in many contexts) is split by window instead: its windows are grouped
by their own text.

A word is removed when a window that covers it also starts in a document with a smaller doc_id; windows are
those of the input.

Edge cases: a null text has no words; a text of fewer words than a window keeps all; a null doc_id counts as
larger than any other, and rows with equal doc_ids don't remove each other's words; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stash, table
from ._text import SPACE, column, hash_runs, mix, runs, slices

WINDOW, GRAM = 50, 16
#: A bucket with more distinct strings than this is split by window.
HEAVY = 256
NO_ID = (1 << 63) - 1
_POS = np.uint64((1 << 26) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def super_kmers(h: np.ndarray, row: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For the hashed words of several rows: row, first word (in all), windows, minimiser and content hash."""
    n, spread = len(h), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    last = np.cumsum(np.bincount(row))[row]  # the end of each word's row
    g = h[: n - gram + 1].copy()
    for k in range(1, gram):
        g = g * _STEP + h[k : n - gram + 1 + k]
    grams = mix(g)
    at = np.arange(len(grams), dtype=np.uint64)
    value = (grams & ~_POS) | at
    value[at.astype(np.int64) + gram > last[: len(grams)]] = ~np.uint64(0)
    low, have = value, 1  # least values of runs, by doubling
    while 2 * have <= spread:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    low = np.minimum(low[: len(value) - spread + 1], low[spread - have : len(value) - have + 1])
    start = np.flatnonzero(np.arange(len(low)) + window <= last[: len(low)])
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    place = (low[start] & _POS).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[start[1:]] != row[start[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    s = start[first]
    e = s + count + window - 1
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _STEP, np.uint64))])
    inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _UNSTEP, np.uint64))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h) * powers[:n], dtype=np.uint64)])
    content = mix((sums[e] - sums[s]) * inverse[s] + count.astype(np.uint64))
    return row[s], s, count, grams[place[first]], content


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            raw, offsets = column(batch, "text")
            starts, ends, row = runs(~SPACE[raw], offsets)
            r, s, n, key, content = super_kmers(hash_runs(raw, starts, ends), row)
            begin = np.cumsum(np.bincount(row, minlength=batch.num_rows)) - np.bincount(row, minlength=batch.num_rows)
            at = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array((s - begin[r]) * 64 + n)],
                names=["ord", "th", "key", "sid", "sn"],
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their way through a shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw, offsets = column(batch, "text")
        data = raw.tobytes()
        z = [press.compress(data[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(z, pa.binary())], names=["doc_id", "ord", "th", "z"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed strings of the super-k-mers that are wanted of each document."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for z, first, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = unpack.decompress(z).split()
            for one in wanted:
                s, n = divmod(one["sn"], 64)
                for k, v in enumerate((one["key"], one["sid"], first, b" ".join(words[s : s + n + WINDOW - 1]).decode())):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["key", "sid", "first", "packed"])


def first_of_windows(strings: list[str], first: list[int], window: int = WINDOW) -> list[list[int]]:
    """For every window of every packed string, the least ``first`` of the strings that contain it."""
    windows, owner, place = [], [], []
    result = []
    for k, string in enumerate(strings):
        words = string.split(" ")
        ends = np.cumsum([len(w) + 1 for w in words])
        begins = [0, *ends[:-1].tolist()]
        n = len(words) - window + 1
        result.append([0] * n)
        for i in range(n):
            windows.append(string[begins[i] : int(ends[i + window - 1]) - 1])
            owner.append(k)
            place.append(i)
    order = sorted(range(len(windows)), key=windows.__getitem__)
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and windows[order[to]] == windows[order[at]]:
            to += 1
        least = min(first[owner[x]] for x in order[at:to])
        for x in order[at:to]:
            result[owner[x]][place[x]] = least
        at = to
    return result


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, at most HEAVY a key; a bucket may go on in the next batch."""
    rest: list[tuple] = []

    def done(rows: list[tuple]) -> Iterator[tuple]:
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            for r, least in zip(rows[at:to], first_of_windows([r[3] for r in rows[at:to]], [r[2] for r in rows[at:to]])):
                yield r[0], r[1], least
            at = to

    def batch_of(found: Iterator[tuple]) -> pa.RecordBatch:
        key, sid, least = (list(x) for x in zip(*rows)) if (rows := list(found)) else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(sid, pa.int64()), pa.array(least, pa.list_(pa.int64()))], names=["key", "sid", "least"])

    for batch in batches:
        rows = rest + list(zip(*(c.to_pylist() for c in batch.columns)))
        if not rows:
            continue
        at = len(rows)
        while at and rows[at - 1][0] == rows[-1][0]:
            at -= 1
        rest = rows[at:]
        yield batch_of(done(rows[:at]))
    yield batch_of(done(rest))


def _split_by_window(strings: DataFrame) -> DataFrame:
    """``(key, sid, least)`` of buckets of any size: windows meet by their own text."""
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - WINDOW + 1), lambda i: F.array_join(F.slice("w", i, F.lit(WINDOW)), " "))
    rows = strings.select("key", "sid", "first", F.split("packed", " ").alias("w")).select("key", "sid", "first", F.posexplode(windows).alias("i", "text"))
    rows = stash(rows, "repeats-windows")
    least = stash(rows.groupBy("text").agg(F.min("first").alias("m")), "repeats-least")
    by = rows.join(least, "text").groupBy("key", "sid").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("by"))
    return by.select("key", "sid", F.transform("by", lambda x: x["m"]).alias("least"))


def _rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, ord, th, text)``: th tells texts with equal ids apart, where there are any."""
    ids = docs.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    th = F.lit(0).cast("long") if ids[0] == ids[2] else F.xxhash64("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), th.alias("th"), "text")


def _repeats(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ord, th, runs)`` with the repeated windows of each document, each run as start * 64 + windows;
    and the compressed texts."""
    pieces = rows.select("ord", "th", "text").mapInArrow(_pieces, "ord long, th long, key long, sid long, sn long")
    packed = rows.mapInArrow(_packed, "doc_id long, ord long, th long, z binary")
    by_key = pieces.groupBy("key").agg(*[f(c).alias(f"{n}_{c}") for c in ("ord", "sid") for n, f in (("min", F.min), ("max", F.max))])
    shared = stash(by_key.where("min_ord < max_ord").select("key", F.col("min_ord").alias("first"), (F.col("min_sid") < F.col("max_sid")).alias("several")), "repeats-keys")
    found = stash(pieces.join(shared, "key"), "repeats-pieces")
    # buckets of one string: its first document settles all its windows
    plain = found.where("not several and first < ord").select("ord", "th", F.array("sn").alias("runs"))
    mixed = found.where("several")
    strings = mixed.groupBy("key", "sid").agg(F.min(F.struct("ord", "th", "sn")).alias("rep"))
    strings = stash(strings.select("key", "sid", "rep.*"), "repeats-strings")
    heavy = stash(strings.groupBy("key").agg((F.count("*") > HEAVY).alias("heavy")), "repeats-heavy")
    wanted = strings.join(heavy, "key").groupBy("ord", "th", "heavy").agg(F.collect_list(F.struct("key", "sid", "sn")).alias("wanted"))
    texts = packed.alias("p").join(wanted.alias("w"), F.expr("p.ord = w.ord and p.th = w.th"))
    texts = texts.select("p.z", F.col("p.ord").alias("first"), "w.wanted", "w.heavy")
    extract = "key long, sid long, first long, packed string"
    packs = stash(texts.select("z", "first", F.expr("transform(wanted, x -> named_struct('key', x.key, 'sid', x.sid, 'sn', x.sn))").alias("wanted")).mapInArrow(_extract, extract).distinct(), "repeats-packs")
    packs = packs.join(heavy, "key")
    light = packs.where("not heavy").select("key", "sid", "first", "packed").repartition("key").sortWithinPartitions("key")
    least = light.mapInArrow(_sort_buckets, "key long, sid long, least array<long>")
    least = stash(least.unionByName(_split_by_window(packs.where("heavy").select("key", "sid", "first", "packed"))), "repeats-settled")
    settled = mixed.join(least, ["key", "sid"])
    start = F.shiftright("sn", 6)
    runs_of = F.filter(F.transform("least", lambda m, i: F.when(m < F.col("ord"), (start + i) * 64 + 1)), lambda x: x.isNotNull())
    sorted_out = settled.select("ord", "th", runs_of.alias("runs")).where(F.size("runs") > 0)
    both = plain.unionByName(sorted_out)
    return both.groupBy("ord", "th").agg(F.flatten(F.collect_list("runs")).alias("runs")), packed


def _kept(digest: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            counts: list[list[int]] = [[], []]
            kept: list[str] = []
            for z, runs_of in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = unpack.decompress(z).split()
                removed = np.zeros(len(words) + 1, np.int64)
                if runs_of.is_valid:
                    s, n = np.divmod(np.asarray(runs_of.values), 64)
                    np.add.at(removed, s, 1)
                    np.add.at(removed, s + n + WINDOW - 1, -1)
                    out = np.cumsum(removed)[:-1] > 0
                    counts[1].append(int(out.sum()))
                    joined = b" ".join([words[i] for i in np.flatnonzero(~out)])
                else:
                    counts[1].append(0)
                    joined = b" ".join(words)
                counts[0].append(len(words))
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts[0], pa.int64()), pa.array(counts[1], pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return each


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: the words that stay, joined by spaces, or their SHA-256."""
    found, packed = _repeats(_rows(docs))
    found = stash(found, "repeats-runs")
    joined = packed.alias("p").join(found.alias("f"), F.expr("p.ord = f.ord and p.th = f.th"), "left")
    return joined.select("p.doc_id", "p.z", "f.runs").mapInArrow(_kept(digest), "doc_id long, n_words long, n_removed long, kept string")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated passages leave of every document."""
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, w, unnest(range(1, len(w) - 48)) as s from d where len(w) >= 50),
k as (select doc_id, s, array_to_string(w[s : s + 49], ' ') as t from win),
f as (select t, min(doc_id) as first from k group by t),
gone as (select distinct doc_id, unnest(range(s, s + 50)) as p from k join f using (t) where first < doc_id),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select w.doc_id, string_agg(x, ' ' order by w.p) as t, count(*) as n from word w
         where not exists (select 1 from gone g where g.doc_id = w.doc_id and g.p = w.p) group by w.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id
"""
