"""Rankings against a plain evaluation, and their properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echorank.functions import kernels as K
from echorank.operators import ordering, scaling
from echorank.operators import pairing
from echorank.operators.pairing import ALL_FEATURES, DISTANCES, distance_pairs, load_queries
from echorank.plans import ranking as R
from echorank.plans.refine import BH_FIRST, CHROMA_FIRST, rank_filter_refine

SCHEMA = (
    "id string, key string, scale string, notes string, rp array<double>, rh array<double>, bpm double, "
    "bh array<double>, chroma array<double>, mfcc array<double>"
)


def items(n=40, seed=1, d=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        frames = np.random.default_rng(1000 * seed + k).normal(size=(20, d))
        model = np.concatenate([frames.mean(axis=0), np.cov(frames.T).ravel()]).tolist()
        beats = rng.randint(3, 9)
        rows.append(
            (
                f"s{k}", rng.choice(["A", "C#"]), "minor", "".join(rng.choice("ABCDL") for _ in range(rng.randint(0, 20))),
                [rng.random() for _ in range(6)], [rng.random() for _ in range(4)], float(rng.randint(60, 180)),
                [rng.random() for _ in range(5)], [rng.random() for _ in range(12 * beats)], model,
            )
        )
    return rows


def plain_distances(rows, q):
    asked = next(r for r in rows if r[0] == q)
    out = {}
    for r in rows:
        both = K.GaussianBatch(np.array([r[9], asked[9]]))
        both.invert(), both.log_dets()
        out[r[0]] = {
            "notes": K.edit_distances_to([r[3]], [asked[3]])[0][0],
            "rp": math.dist(r[4], asked[4]),
            "rh": math.dist(r[5], asked[5]),
            "bh": math.dist(r[7], asked[7]),
            "chroma": K.chroma_xcorr_to([np.array(r[8]).reshape(12, -1)], K.ChromaQuery(np.array(asked[8])))[0],
            "skl": K.sym_kl_to(both, both, 1)[0],
            "js": K.jensen_shannon_to(both, both, 1)[0],
            "mfcc": math.dist(both.flat[0], both.flat[1]),
        }
    return out


def plain_scale(f, d, bounds):
    low, high = bounds
    s = (d - low) / (high - low)
    return 1 - s if DISTANCES[f].larger_is_closer else s


def plain_rank(distances, own_bounds=None):
    complete = {i: d for i, d in distances.items() if math.isfinite(d["skl"]) and math.isfinite(d["js"])}
    bounds = own_bounds or {f: (min(d[f] for d in complete.values()), max(d[f] for d in complete.values())) for f in ALL_FEATURES}
    return {i: sum(plain_scale(f, d[f], bounds[f]) for f in ALL_FEATURES) / 8 for i, d in complete.items()}


def wide(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def tables(df):
    labels = {"notes": ["key", "scale"], "bh": ["bpm"]}
    return {s: df.select("id", s, *labels.get(s, [])) for s in ("rp", "rh", "bh", "notes", "chroma", "mfcc")}


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = items()
    return rows, wide(spark, rows).cache()


def scores(df):
    return {r.id: r.aggregated for r in df.collect()}


def same(a, b):
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9) for k in a)


def test_merged_and_full_agree_with_plain_evaluation_on_complete_data(catalogue):
    rows, df = catalogue
    want = plain_rank(plain_distances(rows, "s3"))
    merged = R.rank_merged(df, "s3")
    assert merged.columns == ["id", "key", "scale", "bpm", *[DISTANCES[f].scaled for f in ALL_FEATURES], "aggregated"]
    assert same(scores(merged), want)
    assert same(scores(R.rank_full(tables(df), "s3")), want)
    order = [r.id for r in merged.collect()]
    assert order == sorted(want, key=lambda i: (want[i], i))


def test_full_scales_before_the_join(spark, catalogue):
    rows, df = catalogue
    parts = tables(df)
    parts["rp"] = parts["rp"].where("id <> 's9'")
    distances = plain_distances(rows, "s3")
    bounds = {f: (min(d[f] for d in distances.values()), max(d[f] for d in distances.values())) for f in ALL_FEATURES}
    without = [d["rp"] for i, d in distances.items() if i != "s9"]
    bounds["rp"] = (min(without), max(without))
    want = plain_rank({i: d for i, d in distances.items() if i != "s9"}, bounds)
    assert same(scores(R.rank_full(parts, "s3")), want)


def test_batch_is_the_union_of_single_rankings(catalogue):
    _, df = catalogue
    batch = R.rank_batch(df, ["s1", "s2"]).collect()
    for q in ("s1", "s2"):
        assert same({r.id: r.aggregated for r in batch if r.query_id == q}, scores(R.rank_merged(df, q)))
    full = R.rank_full_batch(tables(df), ["s1", "s2"]).collect()
    assert same({r.id: r.aggregated for r in full if r.query_id == "s2"}, scores(R.rank_full(tables(df), "s2")))


@pytest.mark.parametrize("bound, value", [("MAX_QUERIES", 2), ("MAX_QUERY_BYTES", 4000)])
def test_large_batches_are_split(catalogue, monkeypatch, bound, value):
    _, df = catalogue
    want = {(r.query_id, r.id): r.aggregated for r in R.rank_batch(df, ["s1", "s2", "s3"]).collect()}
    monkeypatch.setattr(pairing, bound, value)
    assert same({(r.query_id, r.id): r.aggregated for r in R.rank_batch(df, ["s1", "s2", "s3"]).collect()}, want)


def test_order_of_rows_does_not_matter(spark, catalogue):
    rows, df = catalogue
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    assert R.rank_merged(wide(spark, shuffled), "s5").collect() == R.rank_merged(df, "s5").collect()


def test_query_id_is_normalised_and_must_exist(catalogue):
    _, df = catalogue
    assert R.rank_merged(df, "s 1.").count() == 40
    with pytest.raises(ValueError, match="no item with id"):
        R.rank_merged(df, "nobody")
    with pytest.raises(ValueError, match="no item with id"):
        R.rank_full(tables(df), "nobody")
    with pytest.raises(ValueError, match="unknown features"):
        R.rank_merged(df, "s1", ["taste"])


def test_missing_query_feature_is_an_error(spark):
    df = wide(spark, [("a", "A", "minor", None, *items(1)[0][4:]), ("b", *items(1)[0][1:])])
    with pytest.raises(ValueError, match="no notes feature"):
        R.rank_merged(df, "a")


def test_singular_models_vanish(spark):
    rows = items(12)
    broken = list(rows[4])
    broken[9] = broken[9][:3] + [0.0] * 9
    rows[4] = tuple(broken)
    ranked = scores(R.rank_merged(wide(spark, rows), "s0"))
    assert "s4" not in ranked and len(ranked) == 11
    assert "s4" not in scores(R.rank_full(tables(wide(spark, rows)), "s0"))
    assert "s4" in scores(R.rank_full(tables(wide(spark, rows)), "s0", ["rp", "mfcc"]))


def test_exact_copies_collapse_and_other_duplicates_multiply(spark):
    rows = items(6)
    copies = rows + [rows[2]] * 50
    assert same(scores(R.rank_merged(wide(spark, copies), "s0")), scores(R.rank_merged(wide(spark, rows), "s0")))
    assert R.rank_merged(wide(spark, copies), "s0").count() == 6
    assert R.rank_full(tables(wide(spark, copies)), "s0").count() == 6
    other = list(rows[2])
    other[4], other[5] = [9.0] * 6, [9.0] * 4
    doubled = tables(wide(spark, rows + [tuple(other)]))
    ids = [r.id for r in R.rank_full(doubled, "s0", ["rp", "rh"]).collect()]
    assert ids.count("s2") == 4 and len(ids) == 9  # two rp times two rh


def test_equal_distances_scale_to_null(spark):
    rows = [(f"s{k}", *items(1)[0][1:]) for k in range(3)]
    ranked = R.rank_merged(wide(spark, rows), "s0", ["rp", "rh"]).collect()
    assert [r.id for r in ranked] == ["s0", "s1", "s2"] and all(r.aggregated is None for r in ranked)


def test_one_item_catalogue(spark):
    assert R.rank_merged(wide(spark, items(1)), "s0").count() == 1


def plain_refine(rows, q, order):
    alive = plain_distances(rows, q)
    total = {i: 0.0 for i in alive}
    for f in order:
        d = DISTANCES[f]
        if d.drops_infinite:
            alive = {i: x for i, x in alive.items() if math.isfinite(x[f])}
        values = [x[f] for x in alive.values()]
        if not values:
            return {}
        low, high, mean = min(values), max(values), sum(values) / len(values)
        alive = {i: x for i, x in alive.items() if (x[f] > mean if d.larger_is_closer else x[f] < mean)}
        for i in alive:
            total[i] += plain_scale(f, alive[i][f], (low, high))
    return {i: total[i] / len(order) for i in alive}


@pytest.mark.parametrize("order", [CHROMA_FIRST, BH_FIRST, ("rh", "rp"), ("js", "skl", "mfcc"), ("notes", "bh", "rh")])
def test_filter_refine(catalogue, order):
    rows, df = catalogue
    got = scores(rank_filter_refine(df, "s7", order))
    assert same(got, plain_refine(rows, "s7", order))


def test_filter_refine_for_several_queries(catalogue):
    rows, df = catalogue
    got = rank_filter_refine(df, ["s7", "s8"], ("rh", "rp")).collect()
    for q in ("s7", "s8"):
        assert same({r.id: r.aggregated for r in got if r.query_id == q}, plain_refine(rows, q, ("rh", "rp")))


def test_infinite_distance_counts_until_its_own_step(spark):
    rows = items(20)
    broken = list(rows[4])
    broken[9] = broken[9][:3] + [0.0] * 9
    rows[4] = tuple(broken)
    got = scores(rank_filter_refine(wide(spark, rows), "s0", ("rp", "skl")))
    assert same(got, plain_refine(rows, "s0", ("rp", "skl")))


def test_scores_and_lexicographic_order(catalogue):
    rows, df = catalogue
    ranked = R.rank_scores(tables(df), "s2").collect()
    assert [r.mean for r in ranked] == sorted(r.mean for r in ranked)
    assert all(math.isclose(sum(r.scores) / 8, r["mean"]) for r in ranked)
    ordered = R.rank_scores(tables(df), "s2", lexicographic=True).collect()
    assert [r.scores for r in ordered] == sorted(r.scores for r in ranked)


def test_scaled_values_are_between_zero_and_one(catalogue):
    _, df = catalogue
    columns = [DISTANCES[f].scaled for f in ALL_FEATURES]
    low, high = R.rank_merged(df, "s1").agg(F.least(*[F.min(c) for c in columns]), F.greatest(*[F.max(c) for c in columns])).first()
    assert low >= 0 and high <= 1


def test_null_features_give_null_distances(spark, catalogue):
    _, df = catalogue
    gaps = df.withColumns({c: F.when(F.col("id") != "s5", F.col(c)) for c in ("rp", "notes", "chroma", "mfcc")})
    pairs = distance_pairs(gaps, load_queries(df, ["s1"], ["rp", "notes", "chroma", "mfcc"]), ["rp", "notes", "chroma", "js"])
    row = pairs.where("id = 's5'").first()
    assert (row.distances_rp, row.distances_levenshtein, row.distances_corr, row.distances_js) == (None,) * 4
    assert pairs.where("distances_rp is null").count() == 1


def ranking(spark, n, queries=("a", "b")):
    rng = random.Random(n)
    return [(q, f"i{k}", rng.choice([0.1, 0.1, 0.2, rng.random()])) for q in queries for k in range(n)]


@pytest.mark.parametrize("limit", [1000, 3])
def test_top_k(spark, limit, monkeypatch):
    monkeypatch.setattr(ordering, "GROUP_LIMIT", limit)
    rows = ranking(spark, 300)
    df = spark.createDataFrame(rows, "query_id string, id string, aggregated double")
    got = {(r.query_id, r.id) for r in ordering.top_k(df, 7, by=["query_id"]).collect()}
    want = set()
    for q in "ab":
        best = sorted((r for r in rows if r[0] == q), key=lambda r: (r[2], r[1]))[:7]
        want |= {r[:2] for r in best}
    assert got == want
    top = ordering.top_k(df.where("query_id = 'a'"), 5).collect()
    assert [r.id for r in top] == [r[1] for r in sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[2], r[1]))[:5]]


def test_positions(spark):
    rows = ranking(spark, 500)
    df = spark.createDataFrame(rows, "query_id string, id string, aggregated double").repartition(7)
    per_query = {(r.query_id, r.id): r.position for r in ordering.with_position(df, by=["query_id"]).collect()}
    overall = {(r.query_id, r.id): r.position for r in ordering.with_position(df).collect()}
    for q in "ab":
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (r[2], r[1]))
        assert [per_query[r[:2]] for r in own] == list(range(500))
    assert sorted(overall.values()) == list(range(1000))


def test_stats_and_minmax(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "d double")
    stats = scaling.global_stats(df, ["d"]).first()
    assert (stats.min_d, stats.max_d, stats.mean_d, stats.stddev_d) == (1.0, 5.0, 3.0, 2.0)
    assert [r.s for r in scaling.minmax_scale(df, "d", "s").collect()] == [0.0, 0.5, 1.0]
    assert [r.s for r in scaling.minmax_scale(df, "d", "s", inverted=True).collect()] == [1.0, 0.5, 0.0]
