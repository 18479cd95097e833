import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from millrace.llm import _ordered, mixing


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets_share_everything_under_the_caps(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert math.isclose(sum(got), sum(sizes), abs_tol=1e-6)
    assert all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes))
    free = [(t / w) for t, s, w in zip(got, sizes, weights) if t < 3 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))
    # a capped source would have got at least its cap
    assert all(3 * s / w <= max(free) + 1e-6 for t, s, w in zip(got, sizes, weights) if free and t >= 3 * s - 1e-6)


@given(st.lists(st.integers(0, 60), min_size=1, max_size=8), st.integers(0, 80))
def test_apportionment_is_by_highest_quotient(votes, seats):
    quota = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * quota[k] + 1), -k))
        quota[i] += 1
    assert mixing.sainte_lague([float(v) for v in votes], seats) == quota


def test_quotas_of_shards_add_up():
    _, plans = mixing.plan({"a": 100_000, "b": 3_000, None: 40_000}, shards=5)
    assert [p.source for p in plans] == ["a", "b", None]
    for p in plans:
        assert sum(p.by_shard) == p.quota and min(p.by_shard) >= 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in mixing.op9_mixing(spark, sf_dir).collect()}
    again = {r.doc_id: r for r in mixing.op9_mixing(spark, sf_dir).collect()}
    assert got == again and len(got) == len(docs)
    sums, taken = Counter(), Counter()
    for d in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        assert got[d.doc_id]["size"] == n and 0 <= got[d.doc_id].taken <= 3 * n
        sums[d.source] += n
        taken[d.source] += got[d.doc_id].taken
    names = sorted(sums)
    want = dict(zip(names, mixing.targets([sums[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    for r in got.values():
        assert r.source_size == sums[r.source] and math.isclose(r.target, want[r.source])
    for s in names:
        assert taken[s] == pytest.approx(want[s], rel=0.01)


def test_shards_get_their_quotas(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 9)), f"s{i % 5}") for i in range(2000)]
    rules = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sums = Counter()
    for _, n, s in ((i, 5 + i % 9, f"s{i % 5}") for i in range(2000)):
        sums[s] += n
    block, plans = mixing.plan(dict(sums))
    got = Counter()
    for r in rules:
        passes = [r["size"]] * r.times + ([r.cut_to - r.cut_from + r.wrap_to] if r.taken > r.times * r["size"] else [])
        assert len(passes) == len(r.shards or [])
        for s, n in zip(r.shards or [], passes):
            got[r.source, s] += n
    for p in plans:
        for s, quota in enumerate(p.by_shard):
            assert got[p.source, s] == pytest.approx(quota * block, abs=40)


def test_the_mix_follows_what_is_taken(spark):
    rows = [(i, " ".join(f"w{i}.{k}" for k in range(20 + i % 30)), f"s{i % 4}") for i in range(300)]
    rows += [(i, f"q{i} one two", None) for i in range(5)] + [(None, None, "s1"), (7, "dup dup", "s2"), (7, "dup dup", "s2"), (8, "", "s0")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, source string, times string, n_chars long")
    rules = mixing.mix(df).collect()
    want = Counter()
    for r in rules:
        want[r.doc_id, r.source] += r.taken
    got = Counter()
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        got[r.doc_id, r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == Counter({k: v for k, v in want.items() if v})
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_small_sources_come_near_their_targets_too(spark):
    rows, k = [], 0
    for n in [*range(1, 12), 60, 100, 255, 256, 257, 300]:
        for i in range(n):
            rows.append((k, "w", f"small{n:03}"))
            k += 1
    rows += [(k + i, " ".join(["x"] * 1000), f"big{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"), F.max(F.expr("taken - 3 * size")).alias("over")).collect():
        got[r.source] = (r.n, r.t)
        assert r.over <= 0
    assert len(got) == 20
    for n, t in got.values():
        assert abs(n - t) <= max(1, 0.01 * t)


def test_many_sources_take_a_moment():
    rng = np.random.default_rng(0)
    votes = (rng.pareto(1, 50_000) * 1000).tolist()
    quota = mixing.sainte_lague(votes, 10**9)
    assert sum(quota) == 10**9
    last = min(v / (2 * q - 1) for v, q in zip(votes, quota) if q)
    assert max(v / (2 * q + 1) for v, q in zip(votes, quota)) <= last


def test_repeated_ids_keep_their_own_columns(spark):
    rows = [(1, "a b c", "s", "x"), (1, "a b c", "s", "y"), (1, "d", "s", "z"), (None, "q r", None, "n"), (None, "q r", None, "m")]
    df = spark.createDataFrame([(*r, 0, "keep") for r in rows], "doc_id long, text string, source string, doc string, row int, one string")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    per = Counter((r.doc_id, r.source, r.doc) for r in got.collect())
    assert set(per) <= {(r[0], r[2], r[3]) for r in rows} and all(r.one == "keep" for r in got.collect())
    words = Counter()
    for r in got.collect():
        words[r.doc_id, r.source] += len(r.text.split())
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source] += r.taken
    assert words == want
    by_column = mixing.mix(df).count()
    assert by_column == len(rows)


def test_running_totals_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(_ordered, "PER_CELL", 4)
    monkeypatch.setattr(_ordered, "cells_of", lambda most, real=_ordered.cells_of: real(most, 4))
    rows = spark.range(6000).select((F.col("id") % 5 == 0).alias("hot"), F.when(F.col("id") % 5 < 3, "big").when(F.col("id") % 5 == 3, "small").alias("g"), F.xxhash64("id").alias("h"), (F.col("id") % 11).alias("v"), "id")
    got = _ordered.before(rows, ["g"], ["h", "id"], F.col("v"), 3600, "at").collect()
    assert _ordered.cells_of(3600) >= 8 and len(got) == 6000
    sums = Counter()
    for r in sorted(got, key=lambda r: (str(r.g), r.h % 2**64)):
        assert r["at"] == sums[r.g]
        sums[r.g] += r.v
