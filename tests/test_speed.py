"""Work a recording costs: waves made at once, beats settled in blocks, filters made once."""

import io
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from echorank.functions import loudness, rhythm as R, spectral as S
from echorank.operators.segments import segment_signal
from echorank.plans import extraction as X
from echorank.session import LISTING
from echorank.streaming.media import extract_stream
from workload import audio, signals


def quickest(run, times=3):
    took = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return min(took)


def plain_beats(onsets, per_second, bpm):
    """Frame by frame."""
    period = 60 * per_second / bpm
    spread = np.exp(-0.5 * (np.arange(-int(period), int(period) + 1) * 32 / period) ** 2)
    score = np.convolve(onsets / (onsets.std() or 1.0), spread, "same")[: len(onsets)]
    back = np.arange(-int(round(2 * period)), -max(1, int(round(period / 2))) + 1)
    cost = -S.EVENNESS * np.log(-back / period) ** 2
    total, before = score.copy(), np.full(len(score), -1)
    for t in range(len(score)):
        ways = [(total[t + b] + c, -i) for i, (b, c) in enumerate(zip(back, cost)) if t + b >= 0]
        if ways and max(ways)[0] > 0:
            best, i = max(ways)
            total[t], before[t] = score[t] + best, t + back[-i]
    tail = max(0, len(total) - int(round(period)))
    path = [tail + int(np.argmax(total[tail:]))]
    while before[path[-1]] >= 0:
        path.append(int(before[path[-1]]))
    return np.array(path[::-1])


@pytest.mark.parametrize("frames, bpm", [(1, 60), (20, 200), (700, 47.5), (1500, 133), (900, 239)])
def test_beats_are_those_of_single_steps(frames, bpm):
    rng = np.random.default_rng(frames)
    onsets = rng.random(frames) * (rng.random(frames) < 0.2) + 0.01
    assert S.beat_frames(onsets, 86.13, bpm).tolist() == plain_beats(onsets, 86.13, bpm).tolist()


def test_beats_take_no_step_per_frame():
    onsets = np.random.default_rng(1).random(60_000)
    steps = lambda: [np.argmax(onsets[t : t + 70] + onsets[:70]) for t in range(len(onsets) - 70)]
    assert quickest(lambda: S.beat_frames(onsets, 86.13, 100.0)) < quickest(steps)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Five vectors, one without numbers."""
    root = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, [float(i + j) / 64 for j in range(64)] if i != 3 else None, i % 2) for i in (0, 1, 2, 3, 119)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return root


def test_waves_are_made_at_once(spark, tables):
    waves = audio._waves(spark, tables, 2, lambda t, a: a * t, [F.col("vec_id")])
    found = {r.id: r for r in waves.collect()}
    assert len(found) == 5 and found["song119"].sample_rate == audio.RATE
    assert found["song119"].samples == [119.0 * (i / audio.RATE) for i in range(2 * audio.RATE)]
    assert "lambda" not in waves._jdf.queryExecution().toString()


def test_a_waveform_is_made_once(spark, tables):
    waves = signals.waveforms(spark, tables)
    found = {r.id: r.samples for r in waves.collect()}
    e = [(2 + j) / 64 for j in range(64)]
    assert found["song3"] is None and found["song2"] == e * 1024 + [x / 2 for x in e] * 1024
    plan = segment_signal(waves)._jdf.queryExecution().executedPlan().toString()
    assert "flatten(" not in plan and plan.count("MapInArrow") == 1


def plain_resample(x, rate, to):
    cut = S.BAND * min(1.0, to / rate)
    half = int(np.ceil(S.CROSSINGS / cut))
    out = []
    for n in range(-(-len(x) * to // rate)):
        at = n * rate / to
        i = np.arange(n * rate // to - half + 1, n * rate // to + half + 1)
        t = i - at
        taps = np.sinc(cut * t) * np.i0(S.KAISER * np.sqrt(np.maximum(0, 1 - (t / half) ** 2)))
        out.append((np.where((i >= 0) & (i < len(x)), x[np.clip(i, 0, len(x) - 1)], 0) * taps).sum() / taps.sum())
    return np.array(out)


@pytest.mark.parametrize("rate, to, n", [(48000, 11025, 3000), (44056, 44100, 600), (22050, 11025, 1001), (8000, 44100, 300), (7, 11025, 2), (96001, 11025, 900)])
def test_resampling_is_that_of_single_outputs(rate, to, n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(S.resample(x, rate, to), plain_resample(x, rate, to), atol=1e-9)


def test_a_filter_is_made_once(monkeypatch):
    made, make, kept = [], S._taps, {}
    monkeypatch.setattr(S, "_taps", lambda *a: made.append(a) or make(*a))
    x = np.random.default_rng(0).normal(size=20_000)
    first, n = S.resample(x, 48000, 11025, kept), len(made)
    assert all(np.array_equal(S.resample(x, 48000, 11025, kept), first) for _ in range(5)) and len(made) == n > 0
    for rate in range(8000, 9000, 10):
        S.resample(x[:100], rate, 11025, kept)
    assert len(kept) <= S.FILTERS


def test_loudness_levels_of_all_bands_at_once(monkeypatch):
    db = np.random.default_rng(0).normal(40, 60, (24, 511))
    want = np.empty_like(db)
    for band, curve in enumerate(loudness.band_levels()):
        for i, v in enumerate(db[band]):
            n = min(max(int(np.searchsorted(curve, v)), 1), len(curve) - 1)
            low, high = loudness.PHON_LEVELS[n - 1], loudness.PHON_LEVELS[n]
            want[band, i] = 3 if v <= curve[0] else low + (v - curve[n - 1]) / (curve[n] - curve[n - 1]) * (high - low)
    monkeypatch.setattr(np, "searchsorted", None)
    assert np.allclose(R.to_phon(db), want, atol=1e-9)


def tiny_wav(n=8):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(11025)
        w.writeframes(bytes(range(n)))
    return out.getvalue()


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.wav").write_bytes(tiny_wav())
    listed = X.list_recordings(spark, str(tmp_path))
    assert listed.rdd.getNumPartitions() <= X.spread(spark)
    files, count = X.deal_listing(listed)
    assert count == 300 and files.rdd.getNumPartitions() == X.spread(spark) and len({r.path for r in files.collect()}) == 300
    large = listed.withColumn("length", F.lit(X.TASK_BYTES))
    assert X.deal_listing(large)[0].rdd.getNumPartitions() == 300
    assert X.deal_listing(large.where("id = '7.wav'").withColumn("length", F.lit(None).cast("long")))[0].rdd.getNumPartitions() == 1
    found = X.extract_features(spark, str(tmp_path), ["rh"])
    assert found["errors"].count() == 300 and len(found["errors"].inputFiles()) <= X.spread(spark)


def test_a_stream_looks_up_files_in_few_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(100):
        (tmp_path / "in" / f"{i}.wav").write_bytes(tiny_wav())
    before, tasks = spark.conf.get(LISTING), spark.sparkContext.statusTracker()
    query = extract_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), ["rh"])
    query.awaitTermination()
    stages = [tasks.getStageInfo(s) for j in tasks.getJobIdsForGroup(str(query.runId)) for s in tasks.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= X.spread(spark)
    assert spark.conf.get(LISTING) == before and spark.read.parquet(str(tmp_path / "out")).count() == 100
