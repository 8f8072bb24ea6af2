"""Connected components and the join without a large key, against plain Python."""

import random

import pytest

from echorank.llm.components import components, salted_join


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


def run(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    return sorted((r["id"], r["component"]) for r in components(df).collect())


@pytest.mark.parametrize(
    "links",
    [
        [(1, 2)],
        [(i, i + 1) for i in range(0, 60)],  # a chain
        [(500, i) for i in range(400)] + [(500, 501), (501, 502)],  # a hub that is not the smallest
        [(0, i) for i in range(1, 300)] + [(0, i) for i in range(1, 300)],  # repeated links
        [(1, 1), (None, 2), (3, None), (7, 4), (4, 7)],
    ],
)
def test_components(spark, links):
    assert run(spark, links) == plain(links)


def test_random_graphs(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, 1000 + i) for i in range(1, 200)] + [(1100, 50)]
    assert run(spark, links) == plain(links)
    assert run(spark, []) == []


def test_salted_join(spark):
    left = spark.createDataFrame([(1, n) for n in range(3000)] + [(n, n) for n in range(2, 2000)], "k long, v long")
    right = spark.createDataFrame([(n, -n) for n in range(0, 1500)], "k long, w long")
    salted = salted_join(left, right, "k", "v")
    assert sorted(map(tuple, salted.select("k", "v", "w").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "v", "w").collect()))
    assert sorted(salted.columns) == ["k", "v", "w"]
    assert salted_join(left.limit(0), right, "k", "v").count() == 0
