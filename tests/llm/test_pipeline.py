from collections import Counter

import corpus_pipeline
from millrace.llm import mixing, quality
from millrace.llm._common import stash, table

from .test_decontam import plain as plain_hits
from .test_minima import plain_set
from .test_simhash import plain_fingerprint, plain_roots

NAMES = ["quality classifier", "near duplicates", "benchmark decontamination", "source mix", "shards"]


def test_every_stage_against_brute_force(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        return stash(stages[name](spark, df, sf_dir), "test")

    good = step(NAMES[0], docs)
    scores = quality.op7_quality(spark, sf_dir).collect()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores if r.predicted}
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    assert sum(labels.get(r.doc_id) == 1 for r in good.collect()) == sum(labels.values())

    first = step(NAMES[1], good)
    # fingerprints within four bits are links; so are like sets of shingles, save for the error of the estimate
    texts = {r.doc_id: r.text or "" for r in good.collect()}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    ids = sorted(fps)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    sets = {d: plain_set(t) for d, t in texts.items()}
    likes = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for i, a in enumerate(ids) for b in ids[i + 1 :] if not sets[a].isdisjoint(sets[b])]
    stays = {r.doc_id for r in first.collect()}
    most = plain_roots(ids, near + [(a, b) for a, b, j in likes if j >= 0.88])
    least = plain_roots(ids, near + [(a, b) for a, b, j in likes if j >= 0.72])
    assert {d for d in ids if least[d] == d} <= stays <= {d for d in ids if most[d] == d}

    clean = step(NAMES[2], first)
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert {r.doc_id for r in clean.collect()} == {d for d, _, hit, _ in plain_hits([(r.doc_id, r.text) for r in first.collect()], items) if not hit}

    mixed = step(NAMES[3], clean)
    want = Counter({r.doc_id: r.taken for r in mixing.mix(clean).collect() if r.taken})
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
    assert got == want
    for df in (good, first, clean, mixed):
        assert df.columns == columns

    last = step(NAMES[4], mixed).toPandas()
    assert Counter(last.text) == Counter(r.text for r in mixed.collect())
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in last.groupby("shard"))


def test_odd_rows_pass_all_stages(spark, sf_dir):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "some text here", "en", "s", 3), (2, "", "en", None, 0), (2, "other words", "en", "s", 1), (3, "x " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        kept = []
        for _, stage in corpus_pipeline.STAGES[1:]:
            df = stash(stage(spark, df, sf_dir), "test")
            kept.append({(r.doc_id, r.text) for r in df.collect()})
        if kept[0]:
            # the texts without words are one class, of which the first row stays
            assert kept[0] == kept[1] == {(1, None), (None, "some text here"), (2, "other words"), (3, "x " * 50_000)}
            assert kept[3] == kept[2] and {d for d, _ in kept[2]} <= {1, None, 2, 3}
        else:
            assert not any(kept)
    good = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert good.columns == docs.columns and corpus_pipeline.STAGES[0][1](spark, docs.limit(0), sf_dir).count() == 0


def test_run_gives_the_last_stage(spark, sf_dir):
    assert {"doc_id", "text", "shard", "slot", "law"} <= set(corpus_pipeline.run(spark, sf_dir).columns)
