import hashlib
import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import substrings
from millrace.llm._text import mix


def plain(docs):
    """(doc_id, text) rows to (n_words, n_removed, kept) by looking at every window."""
    key = lambda i: float("inf") if i is None else i
    first, words = {}, []
    for i, text in docs:
        w = (text or "").encode().split()
        words.append(w)
        for s in range(len(w) - 49):
            k = b" ".join(w[s : s + 50])
            first[k] = min(first.get(k, float("inf")), key(i))
    out = []
    for (i, _), w in zip(docs, words):
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[b" ".join(w[s : s + 50])] < key(i):
                gone[s : s + 50] = [True] * 50
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@given(st.integers(0, 10**6), st.sampled_from([(5, 2), (8, 4), (50, 16)]), st.sampled_from([2, 40, 10**6]))
def test_super_kmers_hold_every_window_once(seed, sizes, spread):
    window, gram = sizes
    rng = np.random.default_rng(seed)
    lens = rng.integers(0, 130, 3)
    h, row = mix(rng.integers(0, spread, lens.sum()).astype(np.uint64)), np.repeat(np.arange(3), lens)
    r, s, n, key, sid = substrings.super_kmers(h, row, window, gram)
    begin = np.concatenate([[0], np.cumsum(lens)])
    assert sorted(int(a) + i for a, c in zip(s, n) for i in range(c)) == [begin[k] + i for k in range(3) for i in range(lens[k] - window + 1)]
    keys, strings = {}, {}
    for a, c, k, q in zip(s, n, key, sid):
        assert c <= window - gram + 1
        assert strings.setdefault(tuple(h[a : a + c + window - 1]), q) == q
        for i in range(c):
            assert keys.setdefault(tuple(h[a + i : a + i + window]), k) == k


def test_whole_table_against_all_windows(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in plain(docs)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op2_substrings(spark, sf_dir).collect()}
    assert got == want and any(m for _, m, _ in want.values())


def test_frequent_passages_and_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, line = some(60), some(30)
    docs = [(i, f"{some(rng.randrange(40))} {passage} {some(40)} {line}\n{some(rng.randrange(60))}") for i in range(40)]
    docs += [(50, docs[3][1]), (50, docs[3][1]), (50, f"{some(20)}\t{passage}"), (None, docs[4][1]), (None, None), (60, None), (61, ""), (62, "x " * 300), (63, "x " * 120)]
    table = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, key string")
    want = sorted(plain(docs), key=str)
    for heavy in (256, 4):
        monkeypatch.setattr(substrings, "HEAVY", heavy)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(table).collect()), key=str)
        assert got == want
    assert substrings.remove_repeats(table.limit(0)).count() == 0
