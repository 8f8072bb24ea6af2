"""Medians, moments, Gaussian models, beats."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echorank.operators import beats as B
from echorank.operators.joins import interval_join, previous_value
from echorank.operators.medians import grouped_median
from echorank.operators.models import gaussian_model
from echorank.operators.moments import moments7, segment_mean, segment_median, segment_stats
from echorank.functions.rhythm import row_moments


@pytest.mark.parametrize("small_group", [0, 50, 10_000])
def test_grouped_median_is_exact_for_every_split(spark, small_group):
    rng = random.Random(4)
    rows = [("hot", rng.choice([1.0, 2.0, rng.random() * 3])) for _ in range(3001)]
    rows += [("even", float(v)) for v in range(60)] + [("one", 7.0), ("copies", 4.0)] + [("copies", 4.0)] * 400
    rows += [("gaps", None), ("gaps", 1.0), ("gaps", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.median for r in grouped_median(df, ["k"], "v", small_group=small_group).collect()}
    want = {}
    for key in {k for k, v in rows if v is not None}:
        want[key] = float(np.median([v for k, v in rows if k == key and v is not None]))
    assert got == want


def test_median_of_a_large_group(spark):
    df = spark.range(300_000).select(F.lit("k").alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"))
    assert grouped_median(df, ["k"], "v", small_group=1000).first().median == df.agg(F.median("v")).first()[0]


def test_moments(spark):
    values = [1.0, 2.0, 2.0, 9.0, -4.0]
    rows = [("a", v) for v in values] + [("flat", 3.0)] * 4
    got = {r.k: r for r in moments7(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    want = row_moments(np.array([values]))[0]
    assert np.allclose([got["a"][m] for m in ("mean", "var", "skew", "kurtosis", "median", "min", "max")], want)
    assert (got["flat"]["var"], got["flat"]["skew"], got["flat"]["kurtosis"]) == (0.0, 0.0, 0.0)


def test_segment_statistics(spark):
    rng = np.random.default_rng(1)
    data = rng.random((7, 4))
    df = spark.createDataFrame([("a", v.tolist()) for v in data] + [("b", [1.0, 2.0, 3.0, 4.0])], "id string, v array<double>")
    get = lambda out: np.array({r.id: r.v for r in out.collect()}["a"])
    assert np.allclose(get(segment_mean(df, ["id"], "v")), data.mean(axis=0))
    assert np.allclose(get(segment_median(df, ["id"], "v")), np.median(data, axis=0))
    assert np.allclose(get(segment_median(df, ["id"], "v", small_group=2)), np.median(data, axis=0))
    assert np.allclose(get(segment_stats(df, ["id"], "v")), row_moments(data.T).ravel(order="F"))


def test_segment_statistics_of_groups_taken_apart(spark):
    """Large groups, ragged ones and ones with gaps go by position, with the same results."""
    rng = np.random.default_rng(5)
    rows = [(k, v.tolist()) for k in ("a", "hot", None) for v in rng.random((40 if k == "hot" else 5, 3))]
    rows += [("ragged", [1.0]), ("ragged", [3.0, 5.0]), ("gap", [None, 2.0]), ("gap", [4.0, 6.0]), ("void", None), ("empty", [])]
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(4)
    for statistic in (segment_mean, segment_median, segment_stats):
        whole, apart = ({r.id: r.m for r in statistic(df, ["id"], "v", "m", group_values=n).collect()} for n in (60, 0))
        assert set(whole) == set(apart) == {"a", "hot", None, "ragged", "gap"}
        assert all(np.allclose(whole[k], apart[k]) for k in whole if k is not None or statistic is not segment_stats)
    want = np.array([v for k, v in rows if k is None])
    assert np.allclose(whole[None], row_moments(want.T).ravel(order="F"))
    means = {r.id: r.m for r in segment_mean(df, ["id"], "v", "m").collect()}
    assert means["ragged"] == [2.0, 5.0] and means["gap"] == [4.0, 4.0]
    plan = segment_mean(df, ["id"], "v", "m")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_gaussian_model(spark):
    frames = np.random.default_rng(2).random((30, 13))
    row = gaussian_model(spark.createDataFrame([("a", f.tolist()) for f in frames], "id string, v array<double>")).first()
    cov = np.cov(frames.T)
    assert np.allclose(row["mean"], frames.mean(axis=0)) and np.allclose(row["var"], frames.var(axis=0))
    assert np.allclose(row["cov"], cov.ravel()) and np.allclose(row["cov_ut"], cov[np.triu_indices(13)])
    assert len(row["mfcc"]) == 182


def test_previous_value_and_interval_join(spark):
    rng = random.Random(7)
    rows = [("hot", rng.randint(0, 400)) for _ in range(80)] + [("b", 5)]
    df = spark.createDataFrame(rows, "id string, t int")
    for width in (1, 7, 1000):
        found = previous_value(df, "id", "t", width).collect()
        got = sorted((r.id, r.t, r.n, -1 if r.prev is None else r.prev) for r in found)
        want = []
        for key in ("hot", "b"):
            own = sorted({t for k, t in rows if k == key})
            want += [(key, t, rows.count((key, t)), own[n - 1] if n else -1) for n, t in enumerate(own)]
        assert got == sorted(want)
        points = spark.createDataFrame([("hot", p) for p in range(0, 450, 3)] + [("c", 1)], "id string, p int")
        spans = B.beat_intervals(df, "t", width)
        joined = interval_join(points, spans, "id", "p", "start", "end", width).collect()
        cuts = sorted({0} | {t for k, t in rows if k == "hot"})
        want = [(p, s, e) for p in range(0, 450, 3) for s, e in zip(cuts, cuts[1:]) if s <= p < e]
        assert sorted((r.p, r.start, r.end) for r in joined) == want


def plain_beats(frames, beats):
    chroma, notes, previous = [], [], 0
    limit = np.mean([f.sum() for f in frames]) / 2
    for beat in beats:
        part = frames[previous:beat]
        mean = part.mean(axis=0) if len(part) else np.zeros(12)
        chroma.append(mean / mean.sum() if mean.sum() else mean)
        heard = np.zeros(12)
        for f in part:
            if f.sum() > limit:
                heard += np.where(f == f.max(), 1.0, np.where(f < 0.8, 0.0, f))
        notes.append(int(heard.round(9).argmax()))
        previous = beat
    return chroma, notes


def test_beat_chroma_and_notes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    frames = rng.random((60, 12)).round(2)
    frames[20:30] = 0
    beats = [4, 11, 20, 29, 29, 29, 29, 55]
    monkeypatch.setattr(B, "COPY_BLOCK", 2)
    fdf = spark.createDataFrame([("a", n, f.tolist()) for n, f in enumerate(frames)], "id string, frame int, v array<double>")
    bdf = spark.createDataFrame([("a", b) for b in beats], "id string, frame int")
    chroma, notes = plain_beats(frames, beats)
    got = B.beat_chroma(fdf, bdf, width=8).collect()
    want = sorted((b, c.tolist()) for b, c in zip(beats, chroma))
    assert np.allclose([v for _, v in sorted((r.beat, r.chroma) for r in got)], [v for _, v in want])
    got = sorted((r.beat, r.note) for r in B.beat_notes(fdf, bdf, width=8).collect())
    assert got == sorted(zip(beats, notes))
    averaged = frames.copy()
    for start, end in zip([0, *beats], beats):
        if end > start:
            averaged[start:end] = averaged[start:end].mean(axis=0)
    got = sorted((r.beat, r.note) for r in B.beat_notes(fdf, bdf, pre_averaged=True, width=8).collect())
    assert got == sorted(zip(beats, plain_beats(averaged.round(9), beats)[1]))
    matrix = B.chroma_matrix(B.beat_chroma(fdf, bdf.distinct(), width=8)).first().chroma
    distinct = sorted(set(beats))
    assert np.allclose(np.array(matrix).reshape(12, -1).T, plain_beats(frames, distinct)[0])
    assert len(B.note_sequence(B.beat_notes(fdf, bdf, width=8)).first().pitches) == len(beats)


def test_tempo(spark):
    df = spark.createDataFrame([("a", t / 2) for t in range(21)] + [("a", 10.5), ("a", 12.0), ("b", 1.0)], "id string, t double")
    row = B.tempo_histogram(df, width=3.0).first()
    assert (row.id, row.bpm, len(row.bh)) == ("a", 120.0, 250)
    assert row.bh[120] == pytest.approx(21 / 22) and row.bh[40] == pytest.approx(1 / 22)


def test_beat_frame(spark):
    assert spark.range(1).select(B.beat_frame(F.lit(1.0))).first()[0] == 21


def test_every_item_with_a_beat_has_a_tempo_row(spark):
    beats = [("fast", 0.2 * n) for n in range(5)] + [("one", 1.0)] + [("slow", 1.0 * n) for n in range(3)]
    got = {r.id: r for r in B.tempo_histogram(spark.createDataFrame(beats, "id string, t double")).collect()}
    assert set(got) == {"fast", "one", "slow"}
    assert got["one"].bpm is None and sum(got["one"].bh) == 0 and len(got["one"].bh) == 250
    assert abs(got["fast"].bpm - 300) < 1e-6 and sum(got["fast"].bh) == 0
    assert got["slow"].bpm == 60 and got["slow"].bh[60] == 1


def test_moments_of_values_that_differ_by_rounding(spark):
    df = spark.createDataFrame([("a", x) for x in (0.30000000000000004, 0.3, 0.3)], "k string, v double")
    row = moments7(df, ["k"], "v").first()
    assert (row["var"], row["skew"], row["kurtosis"]) == (0, 0, 0)
