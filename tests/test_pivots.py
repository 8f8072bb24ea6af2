"""The pivot index against the full ranking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echorank.operators.ordering import top_k
from echorank.plans.pivots import METRIC, build_index, load_index, pivot_top_k, save_index
from echorank.plans.ranking import rank_batch
from workload.catalogue import SONGS, wide_table

SCHEMA = "id string, rp array<double>, rh array<double>, bh array<double>, mfcc array<double>"


def catalogue(spark, centres, each, noise, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(centres):
        at = [rng.normal(0, 1, n) for n in (30, 12, 8, 6)]
        for i in range(each):
            rows.append((f"s{c:02d}x{i:03d}", *[(v + rng.normal(0, noise, len(v))).tolist() for v in at]))
    return rows


def full(wide, songs, k, features=METRIC):
    ranked = rank_batch(wide, songs, features).select("query_id", "id", "aggregated")
    return sorted((r.query_id, round(r.aggregated, 9) if r.aggregated is not None else None, r.id) for r in top_k(ranked, k, by=["query_id"]).collect())


def found(index, songs, k):
    best, report = pivot_top_k(index, songs, k)
    return sorted((r.query_id, round(r.aggregated, 9) if r.aggregated is not None else None, r.id) for r in best.collect()), report


def test_equals_full_ranking_and_prunes_clusters(spark, tmp_path):
    wide = spark.createDataFrame(catalogue(spark, 20, 40, 0.02), SCHEMA)
    songs = ["s00x000", "s07x011", "s19x039"]
    index = build_index(wide, pivots=12)
    got, report = found(index, songs, 5)
    assert got == full(wide, songs, 5)
    assert report.pairs == 2400 and report.for_scaling < 0.35 * report.pairs and report.for_ranking < 0.1 * report.pairs
    save_index(index, str(tmp_path / "index"))
    again = load_index(spark, str(tmp_path / "index"))
    assert again.features == METRIC and found(again, songs, 5)[0] == got


def test_given_vectors(spark):
    wide = wide_table(spark, "/root/testdata/sf0.001")
    assert found(build_index(wide), SONGS, 10)[0] == full(wide, SONGS, 10)
    assert found(build_index(wide, ("rp", "mfcc"), pivots=3), SONGS[:2], 7)[0] == full(wide, SONGS[:2], 7, ("rp", "mfcc"))


def test_copies_ties_gaps_and_large_k(spark):
    rows = catalogue(spark, 3, 10, 0.3)
    rows += [rows[0], rows[0], ("s00x000", *rows[5][1:]), ("tie1", *rows[4][1:]), ("tie0", *rows[4][1:])]
    rows += [("gap", None, *rows[3][2:]), ("nan", [float("nan")] * 30, *rows[3][2:]), (None, *rows[3][1:])]
    wide = spark.createDataFrame(rows, SCHEMA)
    whole = wide.where("id IS NOT NULL AND id NOT IN ('gap', 'nan')")
    for k in (1, 4, 100):
        assert found(build_index(wide, pivots=4), ["s01x003", "tie0"], k)[0] == full(whole, ["s01x003", "tie0"], k)


def test_a_feature_without_spread_gives_no_scores(spark):
    rows = [(x[0], x[1], [1.0, 2.0], x[3], x[4]) for x in catalogue(spark, 2, 5, 0.3)]
    wide = spark.createDataFrame(rows, SCHEMA)
    got = found(build_index(wide), [rows[0][0]], 3)[0]
    assert got == full(wide, [rows[0][0]], 3) and {a for _, a, _ in got} == {None}


def test_unknown_items_features_and_empty_catalogues(spark):
    wide = spark.createDataFrame(catalogue(spark, 1, 5, 0.3), SCHEMA)
    with pytest.raises(ValueError):
        build_index(wide, ("notes",))
    with pytest.raises(ValueError):
        pivot_top_k(build_index(wide), ["nobody"], 3)
    assert build_index(wide.where(F.lit(False))).table.count() == 0
