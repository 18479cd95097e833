import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import minima, simhash
from millrace.llm._common import stash, table

from .test_simhash import plain_roots


def plain_set(text, shingle=5):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = low.encode().split()
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def likeness(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b)


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])


TEXTS = [None, "", "  ", "One", "one two", "ONE two three four five six", "one two three four five six", "straße " * 9, "a b c d e f g " * 300]


def test_shingles_are_those_of_the_words():
    g, begin = minima.shingles(batch(TEXTS))
    sets = [set(x.tolist()) for x in np.split(g, begin[1:])]
    plain = [plain_set(t) for t in TEXTS]
    for i in range(len(TEXTS)):
        assert len(sets[i]) == len(plain[i])
        for j in range(len(TEXTS)):
            assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])


def test_minima_do_not_depend_on_the_batch():
    keys, sketch = minima.minima(batch(TEXTS))
    for i, t in enumerate(TEXTS):
        one = minima.minima(batch([t]))
        assert one[0][0].as_py() == keys[i].as_py() and one[1][0].as_py() == sketch[i].as_py()
    assert len(minima.minima(batch([]))[0]) == 0


def edited(words, share, rng):
    """The words with every shingle hit or not, so that about ``share`` of the shingles stay."""
    out = list(words)
    for i in rng.sample(range(len(out)), round((1 - share) * len(out) / 5)):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


def test_agreement_estimates_the_likeness():
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    texts = [" ".join(base)] + [" ".join(edited(base, s, rng)) for s in (0.99, 0.95, 0.9, 0.8, 0.6, 0.3) for _ in range(10)]
    sketch = np.array([np.frombuffer(x.as_py(), np.uint8) for x in minima.minima(batch(texts))[1]])
    agree = (sketch == sketch[0]).mean(1)
    errors = [(a - 1 / 256) / (1 - 1 / 256) - likeness(texts[0], t) for a, t in zip(agree, texts)]
    assert abs(np.mean(errors)) < 0.015 and np.max(np.abs(errors)) < 0.12


@pytest.mark.parametrize("large", [minima.LARGE, 6])
def test_links_join_near_copies_only(spark, large):
    rng = random.Random(7)
    texts = []
    for group in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 500))]
        texts += [" ".join(base)] + [" ".join(edited(base, 0.95, rng)) for _ in range(3 if group else 40)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(200)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = stash(simhash.fingerprints(docs, sketched=True), "test")
    of = {r.fp: r.doc_id for r in rows.collect()}
    found = [(of[r.a], of[r.b]) for r in minima.links(rows, 0.8, large).collect()]
    assert all(likeness(texts[a], texts[b]) >= 0.7 for a, b in found)
    want = [(a, b) for a in range(len(texts)) for b in range(a) if likeness(texts[a], texts[b]) >= 0.8]
    got, exact = plain_roots(list(range(len(texts))), found), plain_roots(list(range(len(texts))), want)
    assert sum(got[a] == got[b] for a, b in want) >= 0.95 * len(want)
    assert all(exact[a] == exact[b] for a, b in found)


def test_empty_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 2), (None, "x", 3), (4, "x", 4)], "doc_id long, text string, fp int")
    for df in (docs, docs.limit(0)):
        rows = simhash.fingerprints(df, sketched=True)
        assert rows.count() == df.count() and minima.links(rows.where("doc_id is not null"), 0.8).count() == 0
        kept = simhash.keep_first(df, similarity=0.8)
        assert kept.columns == df.columns
        assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == ([(0, "x"), (1, None), (4, "x")] if df is docs else [])


def test_recall_on_a_table(spark, sf_dir):
    """Against an exact search of all pairs: well above the limit all are in one class, far below none is."""
    docs = table(spark, sf_dir, "documents")
    root = {r.doc_id: r.root for r in simhash._rooted(docs, 4, 4, 0.8).collect()}
    plain = {r.doc_id: r.root for r in simhash._rooted(docs, 4, 4).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    sets = {d: plain_set(t) for d, t in texts.items()}
    likes = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for i, a in enumerate(ids) for b in ids[:i] if not sets[a].isdisjoint(sets[b])]
    sure = [(a, b) for a, b, j in likes if j >= 0.88]
    assert sure and all(root[a] == root[b] for a, b in sure)
    able = [(a, b) for a, b, j in likes if j >= 0.7 or plain[a] == plain[b]]
    able = plain_roots(ids, able + [(a, b) for a in ids for b in ids if a > b and plain[a] == plain[b]])
    assert all(able[a] == able[b] for a, b, _ in likes if root[a] == root[b])


@pytest.mark.parametrize("copies", [0, 25])
def test_no_pair_of_a_large_bucket_is_left_out(spark, copies):
    """Many texts share one band and no other, as those of a frequent passage; a few of them are alike."""
    rng = np.random.default_rng(3)
    n, large = 90, 6
    sketch = rng.integers(0, 256, (n, minima.MINIMA), np.uint8)
    alike = [(0, 40), (40, 80), (7, 8), (89, 3), *((50, 51 + k) for k in range(copies))]
    for a, b in alike:
        sketch[b] = sketch[a]
        sketch[b, rng.choice(minima.MINIMA, 40, replace=False)] += 1
    keys = [[-1, *(100 * i + k for k in range(1, minima.BANDS))] for i in range(n)]
    rows = spark.createDataFrame([(i, k, bytearray(s.tobytes())) for i, (k, s) in enumerate(zip(keys, sketch))], "fp long, keys array<long>, sketch binary").repartition(4)
    found = [tuple(r) for r in minima.links(rows, 0.8, large).collect()]
    links = [(a, b) for a in range(n) for b in range(a) if (sketch[a] == sketch[b]).sum() >= minima.agreeing(0.8)]
    assert set(links) >= {(max(p), min(p)) for p in alike}
    assert {(max(p), min(p)) for p in found} <= set(links)
    assert plain_roots(list(range(n)), found) == plain_roots(list(range(n)), links)
