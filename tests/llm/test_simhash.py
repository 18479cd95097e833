import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import simhash
from millrace.llm.components import connected

WS = {0x20, *range(9, 14)}


def plain_fingerprint(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    words, word = [], b""
    for b in data + b" ":
        if b in WS:
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(max_size=60) | st.lists(st.sampled_from("a B cC é \t \n".split(" ")), max_size=30).map(" ".join))
def test_fingerprint_follows_the_definition(text):
    assert simhash.fingerprint(text.encode("utf-8", "ignore")) % 2**64 == plain_fingerprint(text.encode("utf-8", "ignore").decode())


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_every_near_pair_shares_a_key(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    for step in (1, 7):
        assert any((x ^ y) & (m % 2**64) == 0 for m in simhash.masks(4, step))


def plain_roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@given(st.lists(st.integers(0, 2**20 - 1), unique=True, max_size=60))
def test_tree_joins_what_links(values):
    fps = np.array(values, np.int64)
    pairs = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4]
    for most in (4096, 2):
        edges = simhash.tree(fps, most=most)
        assert all((a ^ b).bit_count() <= 4 for a, b in edges) and len(edges) < max(1, len(values))
        assert plain_roots(values, pairs) == plain_roots(values, edges)


def test_links_across_the_sign_bit():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4):
        for x in rng.integers(-(2**63), 2**63 - 1, 50):
            bits = [63, *rng.choice(63, n - 1, replace=False).tolist()]
            y = x ^ np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in bits]).view(np.int64)
            for most in (4096, 1):
                assert len(simhash.tree(np.array([x, y]), most=most)) == 1
    far = np.array([0, np.array([0b11111 << 59], np.uint64).view(np.int64)[0]])
    assert simhash.tree(far) == []


def test_large_buckets_are_cut_again():
    rng = np.random.default_rng(0)
    sparse = rng.integers(-(2**62), 2**62, 20_000) & 0x7FFFFFFF
    dense = np.array([5 ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(32, 62, (3000, 2))])
    fps = np.unique(np.concatenate([sparse << 31, dense]))
    assert len(simhash.tree(dense, most=100)) == len(np.unique(dense)) - 1
    assert len(simhash.tree(fps, most=500)) == len(simhash._spread(fps, 4))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(300, 200), (200, 300), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == plain_roots(nodes, edges)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_match_brute_force(spark, sf_dir):
    got = simhash.op8_simhash(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    fps = {d: plain_fingerprint(t or "") for d, t in zip(docs.doc_id, docs.text)}
    ids = sorted(fps)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    roots = plain_roots(ids, edges)
    assert dict(zip(got.doc_id, got.fingerprint)) == {d: f"{f:016x}" for d, f in fps.items()}
    assert dict(zip(got.doc_id, got.component_id)) == roots


def test_odd_rows(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, None, "x"), (3, "", None), (None, "a b c d e", "x"), (5, "A  B c\td e", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 2), (3, 2), (None, None), (5, 1)], key=str)
    assert simhash.near_classes(docs.limit(0)).count() == 0


def test_classes_that_share_their_smallest_id_each_keep_a_row(spark):
    a, b = "one two three four five six seven", "red green blue black white grey brown"
    rows = [(5, a), (5, b), (5, b), (9, b), (7, a), (None, a)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(5, a), (5, b), (None, a)], key=str)
