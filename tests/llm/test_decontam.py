import hashlib
import re

from millrace.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    phrases = {}
    for i, text in items:
        w = words_of(text)
        for s in range(max(1, len(w) - window + 1)) if w else []:
            phrases.setdefault(tuple(w[s : s + window]), set()).add(i)
    out = []
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(p) for p in phrases}:
            for s in range(len(w) - n + 1):
                if (p := tuple(w[s : s + n])) in phrases:
                    hit.update(range(s, s + n))
                    found |= phrases[p]
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def test_whole_table_against_plain_search(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.op6_decontam(spark, sf_dir).collect()}
    want = {d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in plain(docs, items)}
    assert got == want and any(x[4] for x in got.values())


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(14))
    items = [(1, long.upper()), (2, "short one, É"), (3, None), (4, "..."), (5, long), (None, "null item"), (7, "a a a a a a a a a a a")]
    docs = [(1, f"x {long} y"), (1, f"x {long} y"), (1, "short ONE É"), (None, "é short one é"), (5, None), (6, ""), (7, "null item!"), (8, "a " * 30), (9, " ".join(long.split()[:9])), (10, "z " * 40_000 + long)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, th long")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, th long")
    got = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in decontam.contamination(d, b).collect()}
    assert got == {(i, h, tuple(x)) for i, _, h, x in plain(docs, items) if h}
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(i), t) for (i, t), p in zip(docs, plain(docs, items)) if not p[2])
    assert decontam.contamination(d.limit(0), b).count() == 0 and decontam.contamination(d, b.limit(0)).count() == 0


def test_large_vocabularies_are_joined_by_shuffle(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three"), (2, "one two")], "doc_id long, text string")
    terms = decontam.vocabulary(decontam.item_windows(items))
    index = decontam.build_index(docs, terms, most_broadcast=0)
    assert {(r.doc_id, r.pos) for r in index.collect()} == {(1, 1), (1, 2), (1, 3), (2, 0), (2, 1)}


def plain_near(docs, items, window=10, span=20):
    phrases = {tuple(w[s : s + window]) for w in (words_of(t) for _, t in items) if w for s in range(max(1, len(w) - window + 1))}
    out = []
    for d, text in docs:
        w = words_of(text)
        near = {p for s in range(max(1, len(w) - span + 1)) for there in [set(w[s : s + span])] for p in phrases if there.issuperset(p)}
        out.append((d, len(near)))
    return out


def test_proximity(spark):
    items = [(1, "alpha beta gamma"), (2, "one one two"), (3, "solo"), (4, None), (5, " ".join(f"w{i}" for i in range(12)))]
    docs = [(1, "gamma x alpha y beta"), (2, "alpha " + "x " * 17 + "beta gamma"), (3, "beta alpha"), (4, "alpha " + "x " * 18 + "beta gamma"), (5, "two ONE"), (6, "two"), (6, "Solo"), (None, None)]
    docs += [(7, " ".join(f"w{i}" for i in range(11, -1, -1))), (8, "x " * 100 + "w9 w8 w7 w6 w5 y w4 w3 w2 w1 w0 " + "gamma beta beta beta " * 9 + "alpha"), (9, "beta " * 30 + "gamma " + "beta " * 18 + "alpha gamma")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(d, b, span=20).collect()
    want = [(i, n, h) for (i, n), (_, _, h, _) in zip(plain_near(docs, items), plain(docs, items)) if n or h]
    assert sorted(((r.doc_id, r.n_near, r.n_hit) for r in got), key=str) == sorted(want, key=str)
    assert {(i, n > 0) for i, n in plain_near(docs, items)} >= {(1, True), (2, True), (4, False), (7, True), (8, True)}


def test_proximity_over_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(8).collect()]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.n_near for r in decontam.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), b, span=20).collect()}
    assert {k: v for k, v in got.items() if v} == {d: n for d, n in plain_near(docs, items) if n}


def test_an_index_serves_any_test(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "blue"), (3, None)], "doc_id long, text string")
    index = decontam.build_index(docs)
    assert {(r.doc_id, r.n_words) for r in decontam.lengths(index).collect()} == {(1, 3), (2, 1), (3, 0)}
    for text, want in (("green blue", {1}), ("blue", {1, 2})):
        items = spark.createDataFrame([(1, text)], "item_id long, text string")
        assert {r.doc_id for r in decontam.contamination(docs, items, index=index).collect()} == want
