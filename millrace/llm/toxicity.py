"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every step of the network reads a word as the embedding of the whole word beside the mean embedding of its
character 4-grams, so that unseen forms of a known stem still count. A text is cut in overlapping windows of
words; all of them are scored, and the text's score is the calibrated logit of its highest window.

The model is fitted on the driver on a bounded sample of labelled rows outside the held-out fold: at most
``MAX_ROWS`` of either label, none longer than ``MAX_CHARS`` code points. Scoring takes whole texts of any
length. Labels, language, source and id are never inputs.

Edge cases: a null, empty or wordless text is one empty window and gets the network's bias as logit; a null
label or id is not learned from; of repeated labels the larger counts; without two classes to learn from,
every score is the smoothed share of the label; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out, table
from ._text import column, hash_runs, mix, runs, slices
from .boosting import sigmoid

MAX_ROWS = {1: 2_000, 0: 4_000}
MAX_CHARS = 12_000
WINDOW, STRIDE = 48, 32
#: Windows are learned from and scored at every so many words, so that passages of up to 41 words stand whole in one.
SCORE_STRIDE = 8
THRESHOLD = 0.5
DIM, HIDDEN, GRAM = 8, 8, 4
#: Windows in a training step, and how many steps a small sample gets at least.
BATCH, LEAST_STEPS = 128, 300

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The distinct words of some texts, their character grams, and where each text uses which."""

    h: np.ndarray
    grams: np.ndarray
    gram_word: np.ndarray
    index: np.ndarray
    row: np.ndarray


def words_of(batch: pa.RecordBatch) -> Words:
    """Lower-cased runs of letters and digits (any byte outside ASCII counts as a letter)."""
    raw, offsets = column(batch, "text")
    raw = _LOWER[raw]
    starts, ends, row = runs(_LETTER[raw], offsets)
    h, first, index = np.unique(hash_runs(raw, starts, ends), return_index=True, return_inverse=True)
    s, size = starts[first], (ends - starts)[first]
    # grams of "^word": all positions of all distinct words at once
    n = np.maximum(size + 2 - GRAM, 1)
    gram_word = np.repeat(np.arange(len(h)), n)
    at = np.arange(len(gram_word)) - np.repeat(np.cumsum(n) - n, n) - 1
    grams = np.full(len(gram_word), 7, np.uint64)
    for k in range(GRAM):
        pos = at + k
        inside = (pos >= 0) & (pos < size[gram_word])
        byte = np.where(pos < 0, 1, 0)
        if len(raw):
            byte = np.where(inside, raw[np.minimum(s[gram_word] + np.maximum(pos, 0), len(raw) - 1)].astype(np.int64) + 2, byte)
        grams = grams * np.uint64(263) + byte.astype(np.uint64)
    return Words(h, mix(grams), gram_word, index, row)


def windows_of(row: np.ndarray, n_rows: int, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window; the last one of a text ends with it, each text has one."""
    count = np.bincount(row, minlength=n_rows)
    begin = np.cumsum(count) - count
    n = np.maximum(-(-(count - window) // stride), 0) + 1
    text = np.repeat(np.arange(n_rows), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(k * stride, np.maximum(count[text] - window, 0))
    return begin[text] + start, np.minimum(count[text] - start, window), text


@dataclass
class Network:
    """Parameters by name, and the sorted hashes of the known words and grams (row 0: unknown)."""

    words: np.ndarray
    grams: np.ndarray
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def inputs(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An input vector for each distinct word, and the rows of both embeddings it comes from."""
        word, gram = known(self.words, w.h), known(self.grams, w.grams)
        n = np.bincount(w.gram_word, minlength=len(w.h))
        by = np.add.reduceat(self.p["Ec"][gram], np.cumsum(n) - n, axis=0) if len(gram) else np.zeros((0, DIM), np.float32)
        return np.hstack([self.p["Ew"][word], by / np.maximum(n, 1)[:, None]]).astype(np.float32), word, gram

    def run(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows of words ``idx`` (steps, windows) over inputs ``x``; ``mask`` is 0 past the end."""
        p, (steps, n) = self.p, idx.shape
        saved: dict = {"h": {}}
        hidden = np.empty((steps, n, 2 * HIDDEN), np.float32)
        for d in "fb":
            xw = x @ p["W" + d] + p["b" + d]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                a, u = xw[idx[t]], h @ p["U" + d]
                zr = a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
                zr = 0.5 * np.tanh(0.5 * zr) + 0.5
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                m = mask[t][:, None]
                new = h + m * (1 - z) * (c - h)
                if keep:
                    saved["h"][d, t] = (h, z, r, c, u[:, 2 * HIDDEN :])
                h = new
                hidden[t, :, (0 if d == "f" else HIDDEN) : (HIDDEN if d == "f" else 2 * HIDDEN)] = h
        att = np.tanh(hidden @ p["Wa"] + p["ba"])
        e = np.where(mask > 0, att @ p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(0)) * mask
        alpha = e / np.maximum(e.sum(0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", alpha, hidden)
        logit = pooled @ p["w"] + p["c"]
        if keep:
            saved |= {"hidden": hidden, "att": att, "alpha": alpha, "pooled": pooled}
        return logit, saved

    def score_rows(self, batch: pa.RecordBatch) -> np.ndarray:
        """The score of each text of the batch."""
        if self.constant is not None:
            return np.full(batch.num_rows, self.constant)
        return sigmoid(self.scale * self.logits(batch).astype(float) + self.shift)

    def logits(self, batch: pa.RecordBatch, part: int = 512) -> np.ndarray:
        """The highest window logit of each text."""
        w = words_of(batch)
        x = self.inputs(w)[0]
        first, size, text = windows_of(w.row, batch.num_rows, stride=SCORE_STRIDE)
        # windows of about one length run together, for no more steps than they have
        order = np.argsort(size, kind="stable")
        first, size, text = first[order], size[order], text[order]
        best = np.full(batch.num_rows, -np.inf, np.float32)
        forward = self.forward(x if len(x) else np.zeros((1, 2 * DIM), np.float32))
        for at in range(0, len(first), part):
            idx, mask = steps_of(w.index, first[at : at + part], size[at : at + part])
            steps = max(int(size[at : at + part].max()), 1)
            np.maximum.at(best, text[at : at + part], forward(idx[:steps], None if size[at] == steps else mask[:steps]))
        return best

    def forward(self, x: np.ndarray) -> Callable[[np.ndarray, np.ndarray | None], np.ndarray]:
        """The logits that ``run`` gives, for scoring: both directions in one step, a row for each unit, so that
        every operation is on whole rows; ``mask`` is None where no window ends before the last step."""
        p, two = self.p, 2 * HIDDEN
        # the logistic function of the gates is taken as 0.5 tanh(0.5 a) + 0.5
        scale = np.repeat(np.array([0.5, 0.5, 1], np.float32), HIDDEN)
        xf, xb = ((x @ p["W" + d] + p["b" + d]) * scale for d in "fb")
        u = np.zeros((3, 2, HIDDEN, 2, HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            u[:, k, :, k] = (p["U" + d] * scale).T.reshape(3, HIDDEN, HIDDEN)
        u = u.reshape(3 * two, two)
        head = np.vstack([p["Wa"].T, p["w"][None]]).astype(np.float32)

        def logit(idx: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
            steps, n = idx.shape
            hidden = np.empty((steps, two, n), np.float32)
            h, a, g = np.zeros((two, n), np.float32), np.empty((3 * two, n), np.float32), np.empty((3, 2, HIDDEN, n), np.float32)
            for t in range(steps):
                back = steps - 1 - t
                # every place is inside; with mode clip numpy copies without looking first
                g[:, 0] = xf.take(idx[t], axis=0, mode="clip").T.reshape(3, HIDDEN, n)
                g[:, 1] = xb.take(idx[back], axis=0, mode="clip").T.reshape(3, HIDDEN, n)
                inputs = g.reshape(3 * two, n)
                np.matmul(u, h, out=a)
                zr, c = a[: 2 * two], a[2 * two :]
                zr += inputs[: 2 * two]
                np.tanh(zr, out=zr)
                z, r = zr[:two], zr[two:]
                r *= 0.5
                r += 0.5
                c *= r
                c += inputs[2 * two :]
                np.tanh(c, out=c)
                c -= h
                z *= -0.5
                z += 0.5
                c *= z
                if mask is not None:
                    c[:HIDDEN] *= mask[t]
                    c[HIDDEN:] *= mask[back]
                h += c
                hidden[t, :HIDDEN] = h[:HIDDEN]
                hidden[back, HIDDEN:] = h[HIDDEN:]
            seen = head @ hidden
            att = seen[:, :HIDDEN] + p["ba"][:, None]
            e = p["v"] @ np.tanh(att, out=att)
            if mask is not None:
                e = np.where(mask > 0, e, np.float32(-1e9))
            e = np.exp(e - e.max(0))
            if mask is not None:
                e *= mask
            return (e * seen[:, HIDDEN]).sum(0) / np.maximum(e.sum(0), 1e-9) + p["c"]

        return logit


def known(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """1 + the place of each hash, or 0 where it isn't known."""
    if not len(sorted_hashes):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == h, at + 1, 0)


def steps_of(index: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of windows, step by step, and 1 where a window has that step."""
    step = np.arange(WINDOW)[:, None]
    mask = (step < size).astype(np.float32)
    at = np.minimum(first + step, max(len(index) - 1, 0))
    return (index[at] if len(index) else np.zeros_like(at)), mask


def sum_by(key: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each key below ``n``."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(key):
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        out[key[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def gradients(net: Network, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Weighted logistic loss, the gradients of the parameters, and that of the inputs."""
    p, steps = net.p, len(idx)
    logit, s = net.run(x, idx, mask, keep=True)
    prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    loss = float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum())
    d = (weight * (prob - y)).astype(np.float32)
    g = {"w": s["pooled"].T @ d, "c": d.sum()}
    dpool = d[:, None] * p["w"]
    dhidden = s["alpha"][:, :, None] * dpool
    dalpha = np.einsum("tnk,nk->tn", s["hidden"], dpool)
    de = s["alpha"] * (dalpha - (s["alpha"] * dalpha).sum(0))
    g["v"] = np.einsum("tn,tnk->k", de, s["att"])
    datt = de[:, :, None] * p["v"] * (1 - s["att"] ** 2)
    g["Wa"] = np.einsum("tni,tnj->ij", s["hidden"], datt)
    g["ba"] = datt.sum((0, 1))
    dhidden += datt @ p["Wa"].T
    dx = np.zeros_like(x)
    for k, way in enumerate("fb"):
        steps_dx = np.empty((steps, idx.shape[1], 3 * HIDDEN), np.float32)
        gu = np.zeros_like(p["U" + way])
        dh = np.zeros((idx.shape[1], HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
            h, z, r, c, uc = s["h"][way, t]
            dh = dh + dhidden[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            m = mask[t][:, None]
            dn = dh * m
            dz = -dn * (c - h) * z * (1 - z)
            dc = dn * (1 - z) * (1 - c * c)
            dr = dc * uc * r * (1 - r)
            du = np.hstack([dz, dr, dc * r])
            gu += h.T @ du
            steps_dx[t] = np.hstack([dz, dr, dc])
            dh = dh - dn * (1 - z) + du @ p["U" + way].T
        dxw = sum_by(idx.ravel(), steps_dx.reshape(-1, 3 * HIDDEN), len(x))
        g["U" + way], g["W" + way], g["b" + way] = gu, x.T @ dxw, dxw.sum(0)
        dx += dxw @ p["W" + way].T
    return loss, g, dx


def _odds(keys: np.ndarray, row: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that at least ``least`` texts use, and the smoothed log odds of the label where they occur."""
    _, once = np.unique(mix(keys + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    found, at, count = np.unique(keys[once], return_inverse=True, return_counts=True)
    ones = np.bincount(at, y[row[once]], len(found))
    a, b = (ones + 0.3) / (y.sum() + 1), (count - ones + 0.3) / ((1 - y).sum() + 1)
    keep = count >= least
    return found[keep], np.clip(np.log(a / b), -3, 3)[keep]


def fit(batch: pa.RecordBatch, y: np.ndarray, weight: np.ndarray, epochs: int = 4, seed: int = 7) -> Network:
    """Train on the texts of ``batch``; ``weight`` restores the share of each label among all labelled rows.

    Embeddings start from the log odds of their word or gram; then windows are learned by Adam: of a text
    with label 1 the window that scores highest so far, of others that one and further windows.
    """
    y, rng = y.astype(float), np.random.default_rng(seed)
    share = (float((weight * y).sum()) + 1) / (float(weight.sum()) + 2)
    if not len(y) or y.min() == y.max():
        return Network(np.zeros(0, np.uint64), np.zeros(0, np.uint64), {}, constant=share)
    w = words_of(batch)
    learned = np.arange(len(y))[w.row] % 5 > 0
    vocabulary, word_odds = _odds(w.h[w.index][learned], w.row[learned], y, 3)
    gram_of = np.argsort(w.gram_word, kind="stable")
    n = np.bincount(w.gram_word, minlength=len(w.h))
    begin = np.cumsum(n) - n
    pair = np.unique((w.index * len(y) + w.row)[learned])
    once = np.stack([pair // len(y), pair % len(y)])
    use = np.repeat(np.arange(once.shape[1]), n[once[0]])
    k = np.arange(len(use)) - np.repeat(np.cumsum(n[once[0]]) - n[once[0]], n[once[0]])
    grams, gram_odds = _odds(w.grams[gram_of[begin[once[0][use]] + k]], once[1][use], y, 3)

    def small(*shape: int, scale: float = 0.1) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"Ew": small(len(vocabulary) + 1, DIM), "Ec": small(len(grams) + 1, DIM), "Wa": small(2 * HIDDEN, HIDDEN, scale=0.3), "ba": np.zeros(HIDDEN, np.float32), "v": small(HIDDEN, scale=0.3), "w": small(2 * HIDDEN, scale=0.3), "c": np.zeros((), np.float32)}
    p["Ew"][:, 0] = np.concatenate([[0], word_odds])
    p["Ec"][:, 0] = np.concatenate([[0], gram_odds])
    for d in "fb":
        p |= {"W" + d: small(2 * DIM, 3 * HIDDEN, scale=0.3), "U" + d: small(HIDDEN, 3 * HIDDEN, scale=0.3), "b" + d: np.zeros(3 * HIDDEN, np.float32)}
    net = Network(vocabulary, grams, p)
    first, size, text = windows_of(w.row, len(y), stride=SCORE_STRIDE)
    # before any training a window's strength is that of its strongest word
    x = net.inputs(w)[0]
    strength = (x[:, 0] + x[:, DIM])[w.index] if len(w.index) else np.zeros(1)
    rank = np.array([strength[f : f + s].max() if s else -9 for f, s in zip(first, size)])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    t = 0
    wanted = np.zeros(len(w.h), bool)
    # a fifth of the texts is left out of training and sets slope and intercept
    trained = np.arange(len(y)) % 5 > 0
    batches = -(-2 * int(trained.sum()) // BATCH)
    for _ in range(max(epochs, -(-LEAST_STEPS // max(batches, 1)))):
        order = np.lexsort((-rank, text))
        top = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
        top = top[trained[text[top]]]
        other = np.flatnonzero((y[text] == 0) & trained[text])
        chosen = np.concatenate([top, rng.choice(other, min(len(other), len(y)), replace=False)])
        rng.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            some = chosen[at : at + BATCH]
            idx, mask = steps_of(w.index, first[some], size[some])
            used, flat = np.unique(idx, return_inverse=True)
            wanted[:] = False
            wanted[used] = True
            pick = wanted[w.gram_word]
            part = Words(w.h[used], w.grams[pick], np.searchsorted(used, w.gram_word[pick]), None, None)
            x, word, gram = net.inputs(part)
            _, g, dx = gradients(net, x, flat.reshape(idx.shape), mask, y[text[some]], np.full(len(some), 1 / len(some)))
            g["Ew"] = sum_by(word, dx[:, :DIM], len(p["Ew"]))
            g["Ec"] = sum_by(gram, (dx[:, DIM:] / np.maximum(np.bincount(part.gram_word, minlength=len(used)), 1)[:, None])[part.gram_word], len(p["Ec"]))
            t += 1
            for key, v in p.items():
                m1, m2 = moments[key]
                m1 += 0.1 * (g[key] - m1)
                m2 += 0.01 * (g[key] ** 2 - m2)
                v -= (0.02 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        x = net.inputs(w)[0]
        rank = np.concatenate([net.run(x, *steps_of(w.index, first[i : i + 4096], size[i : i + 4096]))[0] for i in range(0, len(first), 4096)])
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, text, rank)
    net.scale, net.shift = _calibrate(best[~trained], y[~trained], weight[~trained])
    return net


def _calibrate(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a ridged logistic fit of the label on the logit."""
    a = np.column_stack([logit, np.ones(len(logit))])
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(a @ theta)
        grad = a.T @ (weight * (p - y)) + 1e-2 * (theta - [1, 0])
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= step / max(1, np.abs(step).max())
    return max(float(theta[0]), 0.05), float(theta[1])


def learn(docs: DataFrame, labels: DataFrame, max_rows: dict[int, int] | None = None, max_chars: int = MAX_CHARS) -> Network:
    """Fit on a bounded sample; only its texts come to the driver."""
    known_labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    once = known_labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    count = {r.y: r["count"] for r in once.groupBy("y").count().collect()}
    chosen = None
    for one in (0, 1):
        part = once.where(F.col("y") == one).orderBy(F.xxhash64("doc_id"), "doc_id").limit((max_rows or MAX_ROWS)[one])
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= max_chars)
    # the broadcast side has the sum of max_rows as rows of two numbers at most
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy("doc_id").toArrow()
    got = got.combine_chunks().to_batches()
    if not got:
        return fit(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}), np.zeros(0), np.zeros(0))
    y = got[0].column("y").to_numpy(zero_copy_only=False)
    weight = np.where(y == 1, count.get(1, 0) / max(1, (y == 1).sum()), count.get(0, 0) / max(1, (y == 0).sum()))
    return fit(got[0], y, weight * len(y) / weight.sum())


def score(docs: DataFrame, model: Network) -> DataFrame:
    """``(doc_id, score)`` of every whole text, in one pass without a shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score_rows(batch).astype(float), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
