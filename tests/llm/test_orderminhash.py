import hashlib

from pyspark.sql import functions as F

from millrace.llm import orderminhash as omh


def pairs(spark, rows, schema="doc_id long, text string, guest string"):
    return omh.fingerprint_pairs(spark.createDataFrame([(*r, "x") for r in rows], schema)).orderBy(F.asc_nulls_last("doc_id")).collect()


def test_whole_table(spark, sf_dir):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in omh.op3_order_minhash(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_next == 1.0 if text == after else True
    long = [r for r in got.values() if r.n_chars > 1000]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def plain_entries(spark, text):
    """The definition, word by word, with Spark's hash looked up for each step."""
    words = text.split()
    k = max(len(words) - 2, min(len(words), 1))
    hash_of = lambda *a: spark.range(1).select(F.xxhash64(*a)).first()[0] % 2**64
    long, lit = lambda x: F.lit(x).cast("bigint"), F.lit
    # 32 bits of a hash above 31 of a position
    kmers = [hash_of(*map(lit, words[i : i + 3])) >> 32 for i in range(k)]
    ranked = sorted((((hash_of(long(h), lit(kmers[:i].count(h))) >> 32) << 31) | i) for i, h in enumerate(kmers))
    bins = {}
    for v in ranked:
        bins.setdefault(v >> 57, []).append(v & (2**31 - 1))
    return [(b << 26) | (hash_of(*[long(kmers[p]) for p in sorted(at[:2])]) >> 38) for b, at in sorted(bins.items())]


def test_fingerprints_follow_the_definition(spark):
    for text in ("a b c d e f g", "x y x y x y x y x y", "one", "a b", ""):
        df = omh.with_fingerprint(spark.createDataFrame([(text,)], "t string"), "t", "fp")
        assert df.first().fp == plain_entries(spark, text), text


def test_order_matters(spark):
    rows = " ".join(f"w{i}" for i in range(400))
    lines = [" ".join(f"w{i}" for i in range(k, k + 20)) for k in range(0, 400, 20)]
    swapped = " ".join(reversed(lines))
    df = omh.with_fingerprint(omh.with_fingerprint(spark.createDataFrame([(rows, swapped)], "a string, b string"), "a", "fa"), "b", "fb")
    assert df.select(omh.likeness("fa", "fb").alias("v")).first().v < 0.75
    assert df.select(omh.likeness("fa", "fa").alias("v")).first().v == 1


def plain_likeness(a, b):
    one, other = ({x >> 26: x for x in v} for v in (a, b))
    both = set(one) | set(other)
    return sum(one.get(k) == other.get(k) for k in both) / len(both) if both else 1.0


def test_likeness_is_that_of_the_entries(spark, sf_dir):
    read = lambda s: [int(s[i : i + 8], 16) for i in range(0, len(s), 8)]
    rows = sorted(omh.op3_order_minhash(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    for r, after in zip(rows, rows[1:] + rows[:1]):
        assert abs(r.near_edited - plain_likeness(read(r.fingerprint), read(r.edited_fingerprint))) < 1e-12
        assert abs(r.near_next - plain_likeness(read(r.fingerprint), read(after.fingerprint))) < 1e-12


def test_blocks_stay_even_and_lose_no_successor(spark, monkeypatch):
    monkeypatch.setattr(omh, "bounds", lambda docs, n, real=omh.bounds: real(docs, n, 50, 64))
    rows = [(i, f"text {i}") for i in range(1000)] + [(2**60, "far away")] + [(None, f"no id {i}") for i in range(700)] + [(5000, f"shared {i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = omh.with_next(df).collect()
    size = {}
    for r in placed:
        size[r.block] = size.get(r.block, 0) + (r.guest == 0)
    assert len(placed) == len(rows) + len(size) and sum(size.values()) == len(rows)
    assert len(size) > 25 and max(size.values()) < 200
    whole = sorted((tuple(r[k] for k in omh.KEY), r.text) for r in placed if not r.guest)
    after = {a[1]: b[1] for a, b in zip(whole, whole[1:] + whole[:1])}
    by_block = {}
    for r in placed:
        by_block.setdefault(r.block, []).append((r.guest, tuple(r[k] for k in omh.KEY), r.text))
    for block in by_block.values():
        block.sort()
        assert block[-1][0] == 1
        for a, b in zip(block, block[1:]):
            assert after[a[2]] == b[2]


def test_odd_rows(spark):
    one = pairs(spark, [(7, "abcdef")])
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1
    got = pairs(spark, [(1, "ab cd"), (1, "ab cd"), (1, "é"), (5 * 10**17, None), (None, "zz"), (-3, "")])
    want = [(-3, "", "ab cd"), (1, "ab cd", "ab cd"), (1, "ab cd", "é"), (1, "é", ""), (5 * 10**17, "", "zz"), (None, "zz", "")]
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((str(i), len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for i, t, n in want)
    assert pairs(spark, []) == []
