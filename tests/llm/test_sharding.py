import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import sharding


def greedy(sizes, capacity):
    shards, load = 1, 0
    for s in sizes:
        if s > capacity:
            return 10**9
        if load + s > capacity:
            shards, load = shards + 1, 0
        load += s
    return shards


def smallest(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(sizes, mid) <= shards else (mid + 1, high)
    return low


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 7), st.integers(1, 12))
def test_bounds_hold_whatever_the_cells(sizes, shards, per_cell):
    parts = [sizes[i : i + per_cell] for i in range(0, len(sizes), per_cell)]
    n = len(parts)
    cells = sharding.Cells(np.arange(n), np.full(n, 9), np.array([sum(p) for p in parts]), np.array([len(p) for p in parts]))
    best = smallest(sizes, shards)
    low = sharding.capacity_of(cells, shards, True)
    split, high = sharding.unsure(cells, shards)
    assert low <= best <= high
    if not len(split):
        assert high == best


def load(placed):
    return placed.groupby("shard")["size"].sum()


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    got = sharding.op5_sharding(spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    text = docs.set_index("doc_id").text.fillna("")
    for i in got.index:
        assert got["size"][i] == len(text[i].encode()) + 16 and got.text_crc32[i] == zlib.crc32(text[i].encode())
    got["text"] = text
    assert (got.groupby("text").shard.nunique() == 1).all()
    for _, one in got.groupby("shard"):
        assert sorted(one.slot) == list(range(len(one)))
    assert got.shard.between(0, 39).all()


def test_the_cut_is_minimax_and_giants_stand_alone(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["x" * int(rng.integers(1, 400)) + f" {i}" for i in range(3000)] + ["giant " * 100] * 900
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    monkeypatch.setattr(sharding, "FIRST_BITS", 5)
    placed = sharding.shard_documents(df, 8).toPandas()
    giant = placed[placed.text.str.startswith("giant")]
    assert set(giant.shard) == {0} and (placed.shard == 0).sum() == 900
    rest = placed[placed.shard > 0]
    keys = spark.createDataFrame([(t,) for t in set(rest.text)], "text string").selectExpr("text", "shiftrightunsigned(xxhash64(text), 1) k").toPandas()
    order = keys.sort_values("k").text
    size = rest.groupby("text")["size"].sum()
    assert load(rest).max() == smallest([int(size[t]) for t in order], 7)
    at = rest.groupby("text").shard.first()
    assert [at[t] for t in order] == sorted(at)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a"), (4, "a"), (4, "a"), (5, "é" * 50_000)]
    got = sharding.shard_documents(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, size string"), 40).collect()
    assert sorted(r["size"] for r in got) == [16, 16, 17, 17, 17, 100_016]
    assert len({r.shard for r in got if r.text in (None, "")}) == 1 and len({r.shard for r in got if r.text == "a"}) == 1
    assert {r.grown_shard for r in got} == {None} and {r.law for r in got} == {"bytes"}
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
