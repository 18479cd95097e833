import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import boosting, quality, toxicity


def batch(texts):
    return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})


def test_trees_learn_and_cope_with_little():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = boosting.fit(x, y, trees=40)
    fresh = rng.random((500, 4))
    assert ((model.predict(fresh) >= 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 2] > 0.3))).mean() > 0.95
    assert boosting.fit(np.zeros((0, 4)), np.zeros(0)).predict(x[:2]).tolist() == [0.5, 0.5]
    assert boosting.fit(x, np.ones(2000)).predict(x[:1])[0] > 0.99
    assert len(model.predict(x[:0])) == 0


def test_flat_arrays_equal_a_walk_down_the_trees():
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    model = boosting.fit(x, (x[:, 1] > 0.4).astype(float), trees=5, depth=3)
    for row, p in zip(x[:50], model.predict(x[:50])):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))


def test_statistics_do_not_depend_on_neighbours():
    texts = ["a b a a.", "", None, "  \n", "é | x %%% " * 500, "one"]
    whole = quality.statistics(batch(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.statistics(batch([t]))[0])
    assert not whole[1].any() and not whole[2].any()


def crc_fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize(("query", "label", "least"), [(quality.op7_quality, "quality", 0.95), (toxicity.op4_toxicity, "toxic", 0.8)])
def test_held_out_accuracy(spark, query, label, least):
    at = "/root/testdata/sf0.01"
    got = query(spark, at).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{at}/labels.parquet").toPandas().set_index("doc_id")[label]
    assert len(got) == spark.read.parquet(f"{at}/documents.parquet").count()
    assert all(got.held_out[i] == crc_fold(i) for i in got.index) and got.score.between(0, 1).all()
    both = got.join(labels, how="inner")
    both = both[both.held_out]
    good, bad = both[both[label] == 1].score, both[both[label] == 0].score
    # the chance that a text with label 1 scores higher
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > least


def test_gradients_are_right():
    rng = np.random.default_rng(2)
    texts = ["bad word here and there", "quite fine words", "x"]
    net = toxicity.fit(batch(texts * 4), np.array([1, 0, 0] * 4), np.ones(12), epochs=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w = toxicity.words_of(batch(texts))
    x = net.inputs(w)[0].astype(np.float64)
    first, size, _ = toxicity.windows_of(w.row, 3)
    idx, mask = toxicity.steps_of(w.index, first, size)
    y, weight = np.array([1.0, 0, 0]), np.ones(3)
    _, g, _ = toxicity.gradients(net, x, idx, mask, y, weight)
    for name in ("Wf", "Ub", "bf", "Wa", "v", "w", "Uf"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        loss = []
        for e in (1e-2, -1e-2):
            net.p[name][at] += e
            loss.append(toxicity.gradients(net, x, idx, mask, y, weight)[0])
            net.p[name][at] -= e
        assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-2, rel=0.05, abs=2e-3), name


def test_every_word_is_in_a_window():
    row = np.repeat([0, 2, 3], [10, 48, 133])
    first, size, text = toxicity.windows_of(row, 5)
    assert text.tolist() == [0, 1, 2, *[3] * 4, 4] and size.min() == 0
    covered = np.zeros(len(row), int)
    for f, s in zip(first, size):
        covered[f : f + s] += 1
    assert covered.min() >= 1
    assert first[-2] + size[-2] == 191


def test_unseen_forms_of_a_stem_count_and_late_words_are_found():
    rng = random.Random(4)
    plain = lambda n: " ".join(rng.choice("the of and lorem ipsum dolor sit amet elit sed".split()) + rng.choice(["", "a", "en"]) for _ in range(n))
    toxic = lambda: f"{plain(rng.randrange(60))} grumf{rng.choice(['a', 'en', 'ing', 'o'])} {plain(rng.randrange(60))}"
    texts = [toxic() if i % 2 else plain(rng.randrange(1, 100)) for i in range(240)]
    net = toxicity.fit(batch(texts), np.arange(240) % 2, np.ones(240), epochs=6)
    late = plain(3000) + " grumful"
    got = net.score_rows(batch([late, plain(3000), "", None, "grumfest"]))
    assert got[0] > 0.5 > got[1] and got[4] > 0.5
    assert got[2] == got[3] < 0.5


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine words", 3), (1, "fine words", 3), (None, "bad", 1), (2, None, 1), (3, "", 2)], "doc_id long, text string, score long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module, model in ((quality, quality.learn(docs, none)), (toxicity, toxicity.learn(docs, none))):
        got = module.score(docs, model).collect()
        assert len(got) == 5 and {r.score for r in got} == {0.5}
        assert module.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (2, None, 1), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.learn(docs, labels)).count() == 5
    assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == 5
    assert quality.keep_good(docs, quality.learn(docs, none), 0.4).count() == 5


def test_passages_stand_whole_in_a_scored_window():
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    net = toxicity.fit(batch([" ".join(rng.choice(words, 40)) for _ in range(40)]), np.arange(40) % 2, np.ones(40), epochs=1)
    for _ in range(20):
        text = [str(x) for x in rng.choice(words, 200)]
        alone = net.logits(batch([" ".join(text[i : i + toxicity.WINDOW]) for i in range(0, 152, 8)]))
        assert net.logits(batch([" ".join(text)]))[0] >= alone.max() - 1e-4


def test_scoring_gives_the_logits_of_the_network():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    net = toxicity.fit(batch([" ".join(rng.choice(words, 40)) for _ in range(40)]), np.arange(40) % 2, np.ones(40), epochs=1)
    some = batch([None, "", "-", *(" ".join(rng.choice(words, n)) for n in (1, 2, 7, 47, 48, 49, 56, 57, 300)), *(" ".join(rng.choice(words, 900)) for _ in range(60))])
    w = toxicity.words_of(some)
    x = net.inputs(w)[0]
    first, size, text = toxicity.windows_of(w.row, some.num_rows, stride=toxicity.SCORE_STRIDE)

    def plain():
        best = np.full(some.num_rows, -np.inf, np.float32)
        np.maximum.at(best, text, np.concatenate([net.run(x, *toxicity.steps_of(w.index, first[i : i + 1024], size[i : i + 1024]))[0] for i in range(0, len(first), 1024)]))
        return best

    assert np.abs(net.logits(some) - plain()).max() < 1e-4
    assert np.abs(net.logits(some, 7) - plain()).max() < 1e-4


def test_short_windows_take_no_more_steps_than_they_have(monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    net = toxicity.fit(batch([" ".join(rng.choice(words, 40)) for _ in range(40)]), np.arange(40) % 2, np.ones(40), epochs=1)
    some, plain, done = batch([" ".join(rng.choice(words, 6)) for _ in range(50)]), np.tanh, []
    monkeypatch.setattr(np, "tanh", lambda a, *more, **named: done.append(np.size(a)) or plain(a, *more, **named))
    net.logits(some)
    # gates and candidates of both directions, and the attention
    assert sum(done) == 50 * 6 * (2 * 3 + 1) * toxicity.HIDDEN
