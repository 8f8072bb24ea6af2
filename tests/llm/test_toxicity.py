"""Kneser-Ney models and the classifier on them."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from echorank.llm import toxicity as X
from echorank.llm.toxicity_queries import op10_kneser_ney_toxicity
from echorank.llm.words import ALNUM, Hasher, cut


def models(texts):
    words = cut(pa.array([t for t, _ in texts]), ALNUM, Hasher())
    owner = np.repeat([y for _, y in texts], np.diff(words.first))
    parts = [np.unique(X.packed(words, np.flatnonzero(owner == c))[0], return_counts=True) for c in (0, 1)]
    grams = np.unique(np.concatenate([p[0] for p in parts]))
    counts = np.zeros((2, len(grams)))
    for c, (keys, n) in enumerate(parts):
        counts[c, np.searchsorted(grams, keys)] = n
    return X.Models(grams, counts), grams


TEXTS = [("the idiot and the idiots of it", 1), ("the house and the garden of it", 0), ("a garden in the house is it not", 0), ("what an idiotic thing", 1)]


def test_probabilities_add_up():
    m, grams = models(TEXTS)
    for head in np.unique(grams >> np.uint64(8))[:40]:
        keys = (head << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        p = np.full((2, 256), X.FLOOR)
        for order, x in enumerate(m.levels, 1):
            g = X.low(keys, order)
            place, context = x.grams(g), x.contexts(g >> np.uint64(8))
            p = p * np.where(context >= 0, x.weight[:, context], 1.0) + np.where(place >= 0, x.share[:, place], 0.0)
        assert (p > 0).all() and (abs(p.sum(axis=1) - 1) < 1 / 200).all()  # the floor leaves a 257th out


def test_evidence_and_shared_backoff():
    m, _ = models(TEXTS)
    f = m.figures(cut(pa.array(["such an idiot", "the garden", "zzz qqq", ""]), ALNUM, Hasher()))
    assert f[0, 1] > 1 > 0 > f[1, 0] and np.isnan(f[3]).all()
    assert abs(f[2]).max() < f[0, 1] / 2  # neither class knows these words


WORD = re.compile(b"[0-9a-z\x80-\xff]+")


def plain_words(text):
    return WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def plain_grams(word, order=6):
    line = b" " * (order - 1) + word + b" "
    return [line[i : i + order] for i in range(len(word) + 1)]


def plain_levels(texts):
    """Per class and order: shares by n-gram and backoff weights by context, from the definitions."""
    counts = [Counter(g for t, y in texts if y == c for w in plain_words(t) for g in plain_grams(w)) for c in (0, 1)]
    levels = []
    for order in range(6, 0, -1):
        level = []
        for n in counts:
            once, twice = (sum(v == k for v in n.values()) for k in (1, 2))
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total, kinds = Counter(), Counter()
            for g, v in n.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            level.append(({g: (v - discount) / total[g[:-1]] for g, v in n.items()}, {h: discount * kinds[h] / total[h] for h in total}))
        levels.insert(0, level)
        sets = [set(n) for n in counts]
        sets = [sets[0] | sets[1]] * 2 if order - 1 <= 2 else sets
        counts = [Counter(g[1:] for g in grams) for grams in sets]
    return levels


def plain_figures(levels, text, known):
    def evidence(word):
        if word not in known:
            total = 0.0
            for gram in plain_grams(word):
                p = [1 / 257, 1 / 257]
                for order, level in enumerate(levels, 1):
                    g = gram[-order:]
                    p = [q * weight.get(g[:-1], 1.0) + share.get(g, 0.0) for q, (share, weight) in zip(p, level)]
                total += math.log(p[1]) - math.log(p[0])
            known[word] = total
        return known[word]

    values = sorted(evidence(w) for w in plain_words(text))
    k = max(1, len(values) // 50)
    return (sum(values) / len(values), sum(values[-k:]) / k) if values else None


def test_query_against_plain_models(spark):
    """Every score of the query: counts, backoff, evidence and the logistic fit in plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic", hashed.alias("judge")).collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and docs.get(r["doc_id"]) is not None and len(docs[r["doc_id"]].encode()) <= 1 << 16:
            labels[r["doc_id"], r["judge"]].append(r["toxic"])
    sample = [(docs[i], int(max(y) > 0), judge) for (i, judge), y in labels.items()]
    levels, known = plain_levels([(t, y) for t, y, judge in sample if not judge]), {}
    for rows in ([r for r in sample if r[2]], sample):
        seen = [(plain_figures(levels, t, known), y) for t, y, _ in rows]
        seen = [(f, y) for f, y in seen if f]
        if 0 < sum(y for _, y in seen) < len(seen):
            break
    x, y = np.array([f for f, _ in seen]), np.array([y for _, y in seen], float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a, w = np.column_stack([(x - mean) / scale, np.ones(len(x))]), np.zeros(3)
    ridge = np.array([0.1, 0.1, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.inv(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge)) @ (a.T @ (p - y) + ridge * w)
    prior = sum(y for _, y, _ in sample) / len(sample)
    got = op10_kneser_ney_toxicity(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        f = plain_figures(levels, docs[r["doc_id"]], known)
        score = prior if f is None else 1 / (1 + math.exp(-(((np.array(f) - mean) / scale) @ w[:2] + w[2])))
        assert math.isclose(r["score"], score, rel_tol=1e-6, abs_tol=1e-9), r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op10_kneser_ney_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    r = got.join(labels, "doc_id").where("held_out").agg(
        F.sum(F.col("predicted") * F.col("toxic")).alias("hit"), F.sum("predicted").alias("said"), F.sum("toxic").alias("all")
    ).first()
    assert r["hit"] / r["said"] > 0.85 and r["hit"] / r["all"] > 0.6
    assert got.count() == 1000 and got.where((F.col("score") < 0) | (F.col("score") > 1) | F.isnan("score")).isEmpty()


def test_defined_results(spark):
    docs = [(i, ("you are an idiot and scum " if i % 4 == 0 else "the garden of the house is green ") * 5) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "..."), (None, "idiot"), (503, "idiot " * 100_000), (7, docs[7][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("toxic", F.lit(1))
    labels = [(i, int(i % 4 == 0)) for i in range(120)] + [(4, 0), (5, None), (None, 1), (999, 1)]
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    c = X.fit(d, y)
    scores = {r["doc_id"]: r["s"] for r in X.with_score(d, c, "s").collect()}
    assert all((scores[i] >= 0.3) == (i % 4 == 0) for i in range(120)) and scores[503] >= 0.3 > scores[500] == scores[501] == scores[502]
    kept = X.drop_toxic(d, c, 0.3)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted([i for i in range(120) if i % 4] + [500, 501, 502, 7])
    for some, score in [(y.where("toxic = 1"), 1.0), (y.limit(0), 0.0)]:
        assert {r["s"] for r in X.with_score(d, X.fit(d, some), "s").collect()} == {score}
    assert X.with_score(d.limit(0), c, "s").count() == 0
