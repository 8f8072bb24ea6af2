"""Numpy kernels against plain definitions."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from echorank.functions import kernels as K


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ABCDé", max_size=90), max_size=6), st.lists(st.text("ABCÉ", max_size=140), min_size=1, max_size=3))
def test_edit_distances(texts, queries):
    got = K.edit_distances_to(texts, queries, block=4)
    assert [list(d) for d in got] == [[plain_levenshtein(t, q) for t in texts] for q in queries]


def test_edit_distances_many_pairs_take_the_lockstep_path(monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ABCD"), rng.integers(0, 150))) for _ in range(40)]
    queries = ["".join(rng.choice(list("ABCE"), n)) for n in (1, 63, 64, 65, 127, 128, 129)]
    want = [[plain_levenshtein(t, q) for t in texts] for q in queries]
    for few in (0, 10, 10_000):
        monkeypatch.setattr(K, "FEW_PAIRS", few)
        assert [list(d) for d in K.edit_distances_to(texts, queries)] == want


def plain_xcorr(x, q):
    a, b = (x, q) if x.shape[1] > q.shape[1] else (q, x)
    line = sum(np.correlate(a[i], b[i], "same") for i in range(12))
    line = line - line[0]
    out, level, before = [], 0.0, 0.0
    for value in line:
        level = 0.8632712640 * (value - before) + 0.7265425280 * level
        before = value
        out.append(level)
    return max(out)


@pytest.mark.parametrize("length", [1, 2, 5, 40, 101])
def test_chroma_xcorr(length):
    rng = np.random.default_rng(length)
    query = rng.random((12, length))
    items = [rng.random((12, n)) for n in (1, 2, 3, 4, 39, 40, 41, 100, 101, 102, 250, length)]
    got = K.chroma_xcorr_to(items, K.ChromaQuery(query.ravel()), max_values=5000)
    assert np.allclose(got, [plain_xcorr(x, query) for x in items], atol=1e-7)


def plain_correlate2d_full(a, b):
    rows, cols = a.shape[0] + b.shape[0] - 1, a.shape[1] + b.shape[1] - 1
    padded = np.zeros((rows + b.shape[0] - 1, cols + b.shape[1] - 1))
    padded[b.shape[0] - 1 : b.shape[0] - 1 + a.shape[0], b.shape[1] - 1 : b.shape[1] - 1 + a.shape[1]] = a
    return np.array(
        [[(padded[i : i + b.shape[0], j : j + b.shape[1]] * b).sum() for j in range(cols)] for i in range(rows)]
    )


def test_chroma_xcorr_2d_and_full():
    rng = np.random.default_rng(3)
    for length, other in ((3, 5), (5, 3), (4, 4)):
        query, item = rng.random((12, length)), rng.random((12, other))
        a, b = (item, query) if other > length else (query, item)
        full = plain_correlate2d_full(a, b)
        top, left = (b.shape[0] - 1) // 2, (b.shape[1] - 1) // 2
        want = full[top : top + a.shape[0], left : left + a.shape[1]].max()
        assert np.isclose(K.chroma_xcorr_2d_to([item], K.ChromaQuery(query.ravel()))[0], want)
        turned = plain_correlate2d_full(a.reshape(-1, 12), b.reshape(-1, 12))
        line = turned[:, np.unravel_index(turned.T.argmax(), turned.T.shape)[0]]
        level, before, out = 0.0, 0.0, []
        for value in line:
            level = 0.8632712640 * (value - before) + 0.7265425280 * level
            before = value
            out.append(level)
        assert np.isclose(K.chroma_xcorr_full_to([item], K.ChromaQuery(query.ravel()))[0], max(out), atol=1e-7)


def models(n, d=13, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        frames = rng.normal(size=(60, d)) @ rng.normal(size=(d, d))
        out.append(np.concatenate([frames.mean(axis=0), np.cov(frames.T).ravel()]))
    return np.stack(out)


def test_sym_kl_is_the_elementwise_product_form():
    m = models(4)
    items, asked = K.GaussianBatch(m), K.GaussianBatch(m[:2])
    items.invert(), asked.invert()
    for q in range(2):
        got = K.sym_kl_to(items, asked, q)
        for n in range(4):
            c1, c2, m1, m2 = items.cov[n], asked.cov[q], items.mean[n], asked.mean[q]
            i1, i2 = np.linalg.inv(c1), np.linalg.inv(c2)
            want = 0.25 * (np.trace(c1 * i2) + np.trace(c2 * i1) + np.trace((i1 + i2) * (m1 - m2) ** 2) - 26)
            assert np.isclose(got[n], want)


def test_singular_covariance_gives_infinity():
    m = models(3)
    m[1, 13:] = 0
    items = K.GaussianBatch(m)
    items.invert()
    assert list(np.isinf(K.sym_kl_to(items, items, 0))) == [False, True, False]
    assert np.isinf(K.sym_kl_to(items, items, 1)).all()


def test_jensen_shannon_matches_definition_and_drops_negative_determinants():
    m = models(3, d=3, seed=1)
    items = K.GaussianBatch(m)
    items.log_dets()
    got = K.jensen_shannon_to(items, items, 1)
    for n in range(3):
        mm = (items.mean[n] + items.mean[1]) / 2
        mixed = (items.cov[n] + items.mean[n] ** 2 + items.cov[1] + items.mean[1] ** 2) / 2 - mm**2
        det = np.linalg.det
        with np.errstate(invalid="ignore"):
            want = np.log(det(mixed)) / 2 - np.log(det(items.cov[n])) / 4 - np.log(det(items.cov[1])) / 4
        assert np.isclose(got[n], abs(want)) or (np.isnan(want) and np.isinf(got[n]))
    flipped = m.copy()
    flipped[0, 3:] = np.diag([1.0, 1.0, -1.0]).ravel()
    bad = K.GaussianBatch(flipped)
    bad.log_dets()
    assert np.isinf(K.jensen_shannon_to(bad, items, 1)[0])


def test_model_size_must_fit():
    with pytest.raises(ValueError):
        K.GaussianBatch(np.zeros((1, 5)))
