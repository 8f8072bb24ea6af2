"""The q-gram index against all edit distances."""

import random
from functools import lru_cache

import pytest

from echorank.plans.qgrams import build_gram_index, edit_nearest, edit_within, grams_of, load_gram_index, save_gram_index


@lru_cache(None)
def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        kind = rng.choice("ids")
        if kind == "i":
            out.insert(at, rng.choice("ABCDEFGHIJKL"))
        elif out and at < len(out):
            out[at : at + 1] = [] if kind == "d" else [rng.choice("ABCDEFGHIJKL")]
    return "".join(out)


def case(families=12, each=12):
    rng, rows = random.Random(5), []
    for f in range(families):
        base = "".join(rng.choice("ABCDEFGHIJKL") for _ in range(rng.choice([6, 25, 60, 90])))
        rows += [(f"f{f:02d}n{i:02d}", edited(rng, base, i)) for i in range(each)]
    return rows + [("empty", ""), ("one", "A"), ("é", "éÀABCD"), ("f00n00", rows[0][1]), ("f00n00", "ABCDE"), ("gone", None), (None, "ABC")]


def brute(rows, songs, keep):
    texts = {}
    for i, t in rows:
        if i is not None and t is not None:
            texts.setdefault(i, set()).add(t)
    out = set()
    for s in songs:
        q = min(texts[s])
        out |= set(keep(sorted({(float(levenshtein(q, t)), i) for i, ts in texts.items() for t in ts}), s))
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grams"))
    save_gram_index(build_gram_index(spark.createDataFrame(case(), "id string, notes string"), 3), path)
    return load_gram_index(spark, path, 3)


SONGS = ["f01n00", "f02n05", "empty", "one", "é", "f00n00"]


@pytest.mark.parametrize("d", [0, 1, 5, 40])
def test_within(index, d):
    got = {(r.query_id, r.distance, r.id) for r in edit_within(index, SONGS, d).collect()}
    assert got == brute(case(), SONGS, lambda near, s: [(s, x, i) for x, i in near if x <= d])


@pytest.mark.parametrize("k", [1, 8, 1000])
def test_nearest(index, k):
    best, verified = edit_nearest(index, SONGS, k, first=2)
    got = [(r.query_id, r.distance, r.id) for r in best.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(case(), SONGS, lambda near, s: [(s, x, i) for x, i in near[:k]])


def test_few_pairs_are_verified(spark):
    rows = [r for r in case(60, 10) if r[0] and r[0].startswith("f") and r[1]]
    index = build_gram_index(spark.createDataFrame([r for r in rows if len(r[1]) > 40], "id string, notes string"))
    songs = [i for i, t in rows if len(t) > 50][::40]
    best, verified = edit_nearest(index, songs, 3)
    assert best.count() == 3 * len(songs) and verified < 0.2 * len(songs) * index.items.count()


def test_grams_by_hand():
    found, count = grams_of("ABABA", 2)
    assert sorted(count.tolist()) == [2, 2] and len(found) == 2
    assert len(grams_of("AB", 3)[0]) == 0 and len(grams_of("", 1)[0]) == 0
    assert set(grams_of("XYZ", 2)[0]) == set(grams_of("XY", 2)[0]) | set(grams_of("YZ", 2)[0])


def test_unknown_item_and_no_items(spark, index):
    with pytest.raises(ValueError):
        edit_within(index, ["nobody"], 2)
    assert build_gram_index(spark.createDataFrame([], "id string, notes string")).grams.count() == 0
