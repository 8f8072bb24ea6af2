"""The language model against plain recursions and counts."""

import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from echorank.llm import hmm
from echorank.llm.hmm_queries import op1_hidden_markov_lm

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + ["\n"]


def small_model():
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))


def brute(model, codes):
    return math.log10(
        sum(
            model.start[p[0]] * model.emit[codes[0], p[0]] * math.prod(model.move[a, b] * model.emit[c, b] for a, b, c in zip(p, p[1:], codes[1:]))
            for p in itertools.product(range(3), repeat=len(codes))
        )
    )


def test_forward_sums_over_all_paths():
    model, codes = small_model(), np.array([0, 4, 2, 2, 1, 3, 0, 0, 1])
    begin, size = np.array([0, 2, 3]), np.array([2, 1, 6])
    got = hmm.likelihood(model, codes, begin, size)
    assert np.allclose(got, [brute(model, codes[b : b + n].tolist()) for b, n in zip(begin, size)])
    every = [hmm.likelihood(model, np.array(c), np.array([0]), np.array([3]))[0] for c in itertools.product(range(5), repeat=3)]
    assert abs(sum(10**x for x in every) - 1) < 1e-9


def test_expected_counts_and_growing_likelihood():
    rng, model = np.random.default_rng(3), small_model()
    codes = rng.integers(0, 5, 4000).astype(np.int32)
    sizes, pick = np.array([1, 2500, 700, 799]), np.array([True, True, False, True])
    begin, size = np.array([0, 1, 3201]), np.array([1, 2500, 799])
    last = -np.inf
    for _ in range(5):
        emitted, moved, started = np.zeros((3, 5)), np.zeros((3, 3)), np.zeros(3)
        texts = hmm.pieces(model, codes, sizes, pick)
        assert texts.size.sum() == 3300 and texts.size.max() <= hmm.SEGMENT
        total = hmm.expected(model, codes, texts, emitted, moved, started)
        assert np.isclose(emitted.sum(), 3300) and np.isclose(moved.sum(), 3300 - 3) and np.isclose(started.sum(), 3)
        assert np.isclose(total, hmm.likelihood(model, codes, begin, size).sum()) and total >= last - 1e-9
        last = total
        model = hmm.Model(started / started.sum(), moved / moved.sum(1, keepdims=True), (emitted / emitted.sum(1, keepdims=True)).T)


def plain_expected(model, texts):
    """Expected counts by unscaled recursions over whole texts."""
    classes, states = model.emit.shape
    emitted, moved, started = np.zeros((states, classes)), np.zeros((states, states)), np.zeros(states)
    for codes in texts:
        alpha = [model.start * model.emit[codes[0]]]
        for c in codes[1:]:
            alpha.append((alpha[-1] @ model.move) * model.emit[c])
        beta = [np.ones(states)]
        for c in codes[:0:-1]:
            beta.insert(0, model.move @ (model.emit[c] * beta[0]))
        whole = alpha[-1].sum()
        for t, c in enumerate(codes):
            emitted[:, c] += alpha[t] * beta[t] / whole
            if t:
                moved += model.move * np.outer(alpha[t - 1], model.emit[c] * beta[t]) / whole
        started += alpha[0] * beta[0] / whole
    return emitted, moved, started


def test_counts_of_long_texts_are_those_of_one_sequence(monkeypatch):
    rng, model = np.random.default_rng(5), small_model()
    codes, sizes = rng.integers(0, 5, 200).astype(np.int32), np.array([1, 90, 10, 57, 20, 22])
    for segment, cells in ((7, 30), (10, 1000), (1, 4), (500, 1000)):
        monkeypatch.setattr(hmm, "SEGMENT", segment), monkeypatch.setattr(hmm, "CELLS", cells)
        got = np.zeros((3, 5)), np.zeros((3, 3)), np.zeros(3)
        hmm.expected(model, codes, hmm.pieces(model, codes, sizes, np.ones(6, bool)), *got)
        want = plain_expected(model, np.split(codes, np.cumsum(sizes)[:-1]))
        assert all(np.allclose(g, w) for g, w in zip(got, want))


def stepwise_expected(model, codes, size):
    """Expected counts by a table padded to the longest text, scaled at every token."""
    at = np.minimum(np.cumsum(size) - size + np.arange(size.max())[:, None], len(codes) - 1)
    valid = np.arange(size.max())[:, None] < size
    out = np.where(valid[:, :, None], model.emit[codes[at]], 1.0)
    alpha, beta, scale = np.empty(out.shape), np.ones(out.shape), np.empty((*valid.shape, 1))
    for t in range(len(at)):
        a = (alpha[t - 1] @ model.move if t else model.start) * out[t]
        scale[t] = a @ np.ones((a.shape[1], 1))
        alpha[t] = a / scale[t]
    for t in range(len(at) - 1, 0, -1):
        beta[t - 1] = (out[t] * beta[t] / scale[t]) @ model.move.T
    gamma, later = (alpha * beta)[valid], valid[1:]
    emitted = np.stack([np.bincount(codes[at][valid], g, len(model.emit)) for g in gamma.T])
    moved = model.move * (alpha[:-1][later].T @ (out * beta / scale)[1:][later])
    return emitted, moved, (alpha[0] * beta[0]).sum(axis=0), np.log10(scale[valid]).sum()


def test_counts_take_less_than_scaling_every_token():
    rng = np.random.default_rng(11)
    share = 1 / np.arange(1.0, 5122)
    share /= share.sum()
    model, size = hmm.first_model(share, 8), rng.integers(300, 500, 500)
    codes = rng.choice(5121, int(size.sum()), p=share).astype(np.int32)
    texts = hmm.pieces(model, codes, size, np.ones(500, bool))

    def ours():
        got = np.zeros((8, 5121)), np.zeros((8, 8)), np.zeros(8)
        return *got, hmm.expected(model, codes, texts, *got)

    def seconds(run):
        began = time.thread_time()
        run()
        return time.thread_time() - began

    assert all(np.allclose(g, w) for g, w in zip(ours(), stepwise_expected(model, codes, size)))
    plain = lambda: stepwise_expected(model, codes, size)
    assert min(seconds(ours) for _ in range(5)) < 0.45 * min(seconds(plain) for _ in range(5))


def test_long_texts_are_scored_a_stretch_at_a_time(monkeypatch):
    rng, model = np.random.default_rng(6), small_model()
    codes, size = rng.integers(0, 5, 200).astype(np.int32), np.array([1, 90, 10, 57, 20, 22])
    begin = np.cumsum(size) - size
    want = []
    for text in np.split(codes, begin[1:]):
        a = model.start * model.emit[text[0]]
        for c in text[1:]:
            a = (a @ model.move) * model.emit[c]
        want.append(math.log10(a.sum()))
    for cells, chunk in ((1, 1), (7, 5), (64, 1), (200, 8), (1000, 1000)):
        monkeypatch.setattr(hmm, "CELLS", cells), monkeypatch.setattr(hmm, "CHUNK", chunk)
        assert np.allclose(hmm.likelihood(model, codes, begin, size), want, rtol=1e-12)


def test_rare_classes_do_not_vanish_between_scalings():
    model, codes = small_model(), np.random.default_rng(8).integers(0, 5, 300).astype(np.int32)
    size, pick, begin = np.array([300]), np.array([True]), np.array([0])
    want, got = (np.zeros((3, 5)), np.zeros((3, 3)), np.zeros(3)), (np.zeros((3, 5)), np.zeros((3, 3)), np.zeros(3))
    common = hmm.expected(model, codes, hmm.pieces(model, codes, size, pick), *want)
    rare = hmm.Model(model.start, model.move, model.emit * 1e-40)
    total = hmm.expected(rare, codes, hmm.pieces(rare, codes, size, pick), *got)
    assert math.isclose(total, common - 40 * 300) and math.isclose(total, hmm.likelihood(rare, codes, begin, size)[0])
    assert all(np.allclose(g, w) for g, w in zip(got, want))


def test_scores_against_plain_training(spark, monkeypatch):
    """The whole operator against Baum-Welch and the forward recursion in plain Python."""
    for name, value in (("OWN", 3), ("SHARED", 4), ("SEGMENT", 6)):
        monkeypatch.setattr(hmm, name, value)
    rng = np.random.default_rng(9)
    vocabulary = ["the"] * 9 + ["of"] * 6 + ["house"] * 4 + ["running", "going", "singing", "walked", "Ending", "b", "été"]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 30)))) + (" rare" * (i == 6)), i % 4 == 1) for i in range(16)]
    rows += [(20, None, False), (21, "new words here", True), (0, rows[0][1], False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    got = {r["doc_id"]: r["score"] for r in hmm.score_texts(docs, 2, 3).collect()}

    c = plain_counts([r[1:] for r in rows])
    own = ["\n", *sorted(set(c) - {"\n"}, key=lambda w: -c[w])[:3]]

    def ending(word):
        tail = (word.encode()[::-1][:3] + bytes(3))[:3]
        return int(hmm.mix(np.array([int.from_bytes(tail, "big")], np.uint64))[0]) % 4

    mass = [0.5 + sum(c[w] + 0.5 for w in c if w not in own and ending(w) == k) for k in range(4)]
    share = np.array([*[c[w] + 0.5 for w in own], *mass])
    share /= share.sum()
    code = lambda w: own.index(w) if w in own else 4 + ending(w)
    model = hmm.first_model(share, 2)
    texts = [[code(w) for w in tokens(text)] for _, text, held in rows if not held]
    for _ in range(3):
        emitted, moved, started = plain_expected(model, texts)
        emitted, moved, started = emitted.T + hmm.PRIOR * share[:, None], moved + 0.5, started + 0.5
        model = hmm.Model(started / started.sum(), moved / moved.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))
    for doc, text, _ in rows:
        a, inner = None, 0.0
        for w in tokens(text):
            a = (model.start if a is None else a @ model.move) * model.emit[code(w)]
            inner += 0.0 if w in own else math.log10((c[w] + 0.5) / mass[ending(w)])
        assert math.isclose(got[doc], math.log10(a.sum()) + inner, rel_tol=1e-9)


def plain_counts(rows):
    c = Counter()
    for text, held in rows:
        if not held:
            c.update(tokens(text))
    return c


def check(got, rows, c):
    n, v = sum(c.values()), len(c)
    by_doc = {}
    for doc, text, held in rows:
        t = tokens(text)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        by_doc.setdefault(doc, []).append((held, len(t), sum(c[w] > 0 for w in t), n, base))
    assert len(got) == len(rows)
    for r in got:
        row = (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"])
        assert any(x[:4] == row and math.isclose(x[4], r["base_score"], rel_tol=1e-9, abs_tol=1e-9) for x in by_doc[r["doc_id"]])
        assert math.isfinite(r["score"])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in docs]
    got = op1_hidden_markov_lm(spark, SF).collect()
    check(got, rows, plain_counts([r[1:] for r in rows]))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_defined_results(spark):
    rows = [(1, None, False), (2, "", True), (3, "A a\tb", False), (3, "A a\tb", False), (None, "c", False), (4, "unseen é word", True), (5, "x " * 3000, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").withColumn("block", F.lit(7)).withColumn("word", F.lit("x"))
    check(hmm.score_texts(docs, 2, 2).collect(), rows, plain_counts([r[1:] for r in rows]))
    blank = [(1, None, False), (2, "", False)]
    check(hmm.score_texts(spark.createDataFrame(blank, "doc_id long, text string, held_out boolean"), 2, 1).collect(), blank, plain_counts([r[1:] for r in blank]))
    held = [(1, "a b", True)]
    got = hmm.score_texts(spark.createDataFrame(held, "doc_id long, text string, held_out boolean"), 2, 1).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0)]
    assert hmm.score_texts(spark.createDataFrame([], "doc_id long, text string, held_out boolean"), 2, 1).count() == 0
