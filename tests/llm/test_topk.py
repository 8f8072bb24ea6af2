"""Norm-bucketed search against all products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from echorank.llm import topk


def brute(rows, k, scale, every):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault(i, []).append([math.floor(scale * x) for x in v])
    out = []
    for q, qs in fine.items():
        if q % every == 0:
            pairs = [(-sum(x * y for x, y in zip(a, b)), i) for i, vs in fine.items() if i != q for a in qs for b in vs if len(a) == len(b)]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(pairs)[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5, scale=256, every=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x")).withColumn("v", F.lit(1))
    got = topk.search(df, F.pmod(F.col("vec_id"), F.lit(every)) == 0, k, scale)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


@pytest.mark.parametrize("cells", [False, True])
def test_against_all_products(spark, monkeypatch, cells):
    rng = random.Random(4)
    if cells:  # several cells, blocks and a first threshold from few vectors
        monkeypatch.setattr(topk, "CELL_ROWS", 30)
        monkeypatch.setattr(topk, "QUERY_ROWS", 7)
        monkeypatch.setattr(topk, "SEEDS", 20)
    near = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, [float(x) for x in (rng.gauss(0, 0.3) for _ in range(8))]) for i in range(120)]
    rows += [(200 + i, [x * (1 + i / 20) + rng.gauss(0, 0.05) for x in near]) for i in range(60)]
    rows += [(300 + i, [0.5] * 8) for i in range(40)] + [(400 + i, [0.0] * 8) for i in range(6)] + [(410 + i, [-0.7] * 8) for i in range(6)]
    rows += [(500, None), (505, [None] * 8), (510, [float("nan")] * 8), (515, [float("inf")] * 8), (520, [2.0**40] * 8), (None, [1.0] * 8)]
    rows += [(525, [1.0, 2.0]), (530, [2.0, 1.0]), (535, []), (540, []), (545, [1.0])]
    rows += [(550, [0.9] * 8)] * 3 + [(550, [0.1] * 8), (551, [0.9] * 8), (551, [0.9] * 8)]
    assert run(spark, rows) == brute(rows, 5, 256, 5)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0])]) == []


def all_products(rows, k, scale, every):
    """Every row with finite components, whatever its size."""
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if all(map(math.isfinite, v))]
    out = []
    for q, a in fine:
        if q % every == 0:
            top = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b)))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(top, 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [False, True])
def test_long_vectors_take_part(spark, monkeypatch, cells):
    rng = random.Random(6)
    if cells:
        monkeypatch.setattr(topk, "CELL_ROWS", 20)
        monkeypatch.setattr(topk, "QUERY_ROWS", 7)
        monkeypatch.setattr(topk, "SEEDS", 10)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, [rng.gauss(0, 1) * 10.0 ** rng.randrange(4, 14) for _ in range(6)]) for i in range(60)]
    rows += [(200 + i, [2.0**45 + i, *[0.0] * 5]) for i in range(20)]  # products that differ behind a double's digits
    rows += [(300, [16384.0] + [0.0] * 5), (301, [float("nan")] * 6), (302, [float("inf")] * 6)]
    rows += [(310, [2.0**60 / 3] + [0.0] * 5), (311, [0.0, 1e19] + [0.0] * 4)]  # components and scores beyond 64 bits
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, F.col("vec_id") % 5 == 0, 5, 256)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], int(r["score"])) for r in got.collect()) == all_products(rows, 5, 256, 5)


def test_scores_beyond_64_bits_are_an_error(spark, tmp_path):
    from echorank.llm.topk_queries import op2_norm_bucket_topk

    for size, fits in ((2.0**22, True), (2.0**30, False)):
        rows = [(0, [size, 0.0]), (1, [size, 1.0])]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{size}/embeddings.parquet")
        found = op2_norm_bucket_topk(spark, f"{tmp_path}/{size}")
        if fits:
            assert [tuple(r) for r in found.collect()] == [(0, 1, 1, 2**60)]
        else:
            with pytest.raises(Exception, match="64 bits"):
                found.collect()


def test_few_products_are_verified(spark):
    """Of the given vectors, whose lengths are all alike, coordinates leave few to verify."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    counted = spark.sparkContext.accumulator(0)
    found = topk.search(df, F.col("vec_id") % 50 == 0, 5, 256, counted)
    assert found.count() == 200 and 0 < counted.value < 0.5 * 40 * 2000


def test_bound_holds(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    for dim in (1, 3, 20, 64):
        rows = np.floor(rng.normal(0, 1, (500, dim)) * rng.uniform(1, 1.1, (500, 1)) * 200)
        cell = topk.Cell(np.arange(500), rows, float(np.sqrt((rows**2).sum(axis=1).max())))
        for i in range(0, 500, 25):
            ids, scores = cell.top(rows[i], i, -np.inf, 5)
            want = sorted((-int(s), j) for j, s in enumerate(rows @ rows[i]) if j != i)[:5]
            assert list(zip((-scores).tolist(), ids.tolist())) == want
