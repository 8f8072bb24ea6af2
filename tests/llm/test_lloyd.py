"""Sharded clustering against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echorank.llm.lloyd import lloyd, pack, partial_distances, seeds, unpack, usable, whole

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("e", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.IntegerType())]
)


def plain(vectors, centroids, rounds):
    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for v in vectors:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(col) // len(groups[i]) for col in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    return [nearest(v) for v in vectors], centroids


def run(spark, rows, dims, k, rounds, scale=4, width=3, chunk_rows=5):
    df = spark.createDataFrame(rows, SCHEMA)
    fine = df.where(usable(F.col("e"), dims)).select("vec_id", "e")
    first = seeds(fine, "vec_id", "e", k, "2:", scale)
    assigned, model = lloyd(fine, "vec_id", "e", first, rounds, scale, width, chunk_rows)
    got = sorted(((r["vec_id"], r["cluster"], int(r["distance"])) for r in assigned.collect()), key=str)
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]

    def rank(row):
        return (row[0] is None, hashlib.sha256(f"2:{row[0]}".encode()).hexdigest(), row[1])

    want_first = [v for _, v in sorted(kept, key=rank)[:k]]
    assert first == want_first
    found, centroids = plain([v for _, v in kept], want_first, rounds)
    assert model == centroids
    assert got == sorted(((i, c, d) for (i, _), (d, c) in zip(kept, found)), key=str)
    return got


def test_equals_plain_lloyd(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(7)], 1) for i in range(60)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (None, [0.5] * 7, 0), (100, [0.0] * 7, 0), (101, [0.0] * 7, 0)]
    rows += [(200, None, 0), (201, [1.0] * 6, 0), (202, [1.0] * 6 + [None], 0), (203, [math.nan] * 7, 0), (204, [math.inf] * 7, 0)]
    assert len(run(spark, rows, 7, 6, 3)) == 65


def test_few_rows_none_and_equal_distances(spark):
    assert run(spark, [], 2, 3, 2) == []
    assert run(spark, [(1, None, 0)], 2, 3, 2) == []
    got = run(spark, [(1, [0.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], 0)], 2, 9, 0)
    assert [d for _, _, d in got] == [0] * 4
    assert got[2][1] == got[3][1]  # two equal centroids: the smaller number


def test_large_components(spark):
    """Beyond doubles and 64 bits all steps stay exact."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 9, 17]) for _ in range(4)], 0) for i in range(30)]
    run(spark, rows, 4, 4, 2)


def test_all_rows_of_one_value(spark):
    assert {c for _, c, _ in run(spark, [(i, [1.5, -1.5], 0) for i in range(40)], 2, 3, 2)} == {0}


def test_kernels():
    for values in ([[1, -2]], [[200, 3]], [[70_000, 1]], [[2**40, 1]], [[2**70, -(2**65)]]):
        m = np.array(values, object)
        assert unpack(pack(m), 2).tolist() == values
    assert unpack(pack(np.array([[1, 2], [3, 4]])), 2).tolist() == [[1, 2], [3, 4]]
    assert partial_distances(whole(np.array([[2.0**60, 0.0]])), np.array([[0, 1]])).tolist() == [[2**120 + 1]]


def test_key_name_is_refused(spark):
    with pytest.raises(ValueError):
        lloyd(spark.createDataFrame([(1, [1.0])], "cluster long, e array<double>"), "cluster", "e", [[1]], 1)
