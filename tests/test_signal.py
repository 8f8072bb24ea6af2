"""Rhythm features: reference values, analytic signals, whole extraction."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from echorank.functions import rhythm
from echorank.functions.rhythm import RhythmOptions
from echorank.operators import segments
from echorank.plans import extraction as X

RATE = 11025


def test_reference_values():
    db = np.zeros((24, 1))
    db[0] = 41.13209498
    assert rhythm.to_phon(db)[0, 0] == pytest.approx(25.90299283, abs=1e-7)
    assert rhythm.to_sone(np.array([25.90299283, 47.03087564])) == pytest.approx([0.31726931, 1.62798518], abs=1e-7)


def test_spectrogram_is_a_plain_dft():
    signal = np.random.default_rng(0).normal(size=1024)
    got = rhythm.power_spectrogram(signal, 256)
    assert got.shape == (129, 7)
    taper = np.hanning(256)
    n = np.arange(256)
    for frame in (0, 6):
        for k in (0, 1, 64, 128):
            x = (signal[frame * 128 : frame * 128 + 256] * taper) @ np.exp(-2j * np.pi * k * n / 256)
            want = abs(x) ** 2 / (taper @ taper) * (1 if k == 0 else 2) / (2 * np.pi)
            assert got[k, frame] == pytest.approx(want)


def test_bands_hold_their_lower_edge():
    matrix = rhythm.bark_matrix(513, 44100, 24)
    frequency = np.linspace(0, 22050, 513)
    assert matrix.sum(axis=1)[0] == (frequency < 100).sum()
    assert matrix.sum() == (frequency < 15500).sum()


def test_sine_is_loudest_in_its_band():
    t = np.arange(2**16) / RATE
    sono = rhythm.sonogram(0.1 * np.sin(2 * np.pi * 1000 * t), RATE, RhythmOptions())
    assert sono.shape == (24, 511)
    assert sono.mean(axis=1).argmax() == 8  # 920 to 1080 Hz


def test_dimensions_and_modulation():
    t = np.arange(2**16) / RATE
    beat = np.sin(2 * np.pi * 1000 * t) * (1 + np.sin(2 * np.pi * 4 * t)) / 8
    out = rhythm.segment_vectors(beat, RATE, ("rp", "rh", "ssd", "mvd"), RhythmOptions())
    assert {k: len(v) for k, v in out.items()} == {"rp": 1440, "rh": 60, "ssd": 168, "mvd": 420}
    assert (out["rh"].argmax() + 1) * RATE / 2**16 == pytest.approx(4, abs=0.2)
    with pytest.raises(ValueError, match="modulation"):
        rhythm.modulation(np.ones((1, 30)), 60)
    with pytest.raises(ValueError, match="critical bands"):
        RhythmOptions(bark=False)


def test_moments_match_definitions():
    x = np.random.default_rng(1).random((3, 50))
    x[2] = 0.1
    got = rhythm.row_moments(x)
    gap = x[0] - x[0].mean()
    assert got[0] == pytest.approx(
        [x[0].mean(), x[0].var(), (gap**3).mean() / x[0].var() ** 1.5, (gap**4).mean() / x[0].var() ** 2,
         np.median(x[0]), x[0].min(), x[0].max()]
    )
    assert list(got[2, 1:4]) == [0, 0, 0]


def test_segment_plans(spark):
    size = 2**16
    assert segments.segment_plan(size, RATE) == [0]
    assert segments.segment_plan(3 * size + 5, RATE) == [0, size, 2 * size]
    long = 10 * size
    assert segments.segment_plan(long, RATE) == [n * size for n in range(1, 9)]
    assert segments.segment_plan(long, RATE, skip=0, step=3) == [0, 3 * size, 6 * size, 9 * size]
    with pytest.raises(ValueError, match="not enough"):
        segments.segment_plan(size - 1, RATE)
    with pytest.raises(ValueError, match="not supported"):
        segments.segment_plan(size, 8000)
    lengths = {"one": (size, RATE), "three": (3 * size + 5, RATE), "long": (long, RATE), "short": (9, RATE), "odd": (size, 8000)}
    waves = spark.createDataFrame([(i, r, n) for i, (n, r) in lengths.items()], "id string, sample_rate int, n int")
    waves = waves.select("id", "sample_rate", F.transform(F.sequence(F.lit(1), "n"), lambda k: k.cast("double")).alias("samples"))
    for skip, step in ((1, 1), (0, 3)):
        cut = segments.segment_signal(waves, skip, step).select("id", "start", F.col("samples")[0].alias("first"), F.size("samples").alias("n"))
        got = sorted((r.id, r.start, r.first, r.n) for r in cut.collect())
        want = []
        for i in ("one", "three", "long"):
            want += [(i, s, s + 1.0, size) for s in segments.segment_plan(*lengths[i], skip, step)]
        assert got == sorted(want)
    assert {r.id for r in segments.segment_errors(waves).collect()} == {"short", "odd"}


def wav(path, samples):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(RATE)
        f.writeframes(np.repeat((samples * 32767).astype("<i2"), 2).tobytes())
    path.write_bytes(out.getvalue())


def test_extraction_from_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "in" / "pop").mkdir(parents=True)
    noise = {n: rng.uniform(-0.5, 0.5, 3 * 2**16) for n in range(2)}
    for n, samples in noise.items():
        wav(tmp_path / "in" / "pop" / f"s {n}.wav", samples)
    (tmp_path / "in" / "pop" / "bad.wav").write_bytes(b"nothing")
    out = str(tmp_path / "out")
    types = ["rp", "rh", "ssd", "mvd", "tssd", "trh"]
    result = X.extract_features(spark, str(tmp_path / "in"), types, out)
    assert {r.id for r in result["errors"].collect()} == {"pop/bad.wav"}
    audit = {r.id: r for r in result["audit"].collect()}
    assert audit["pop/s 1.wav"].segments == 3 and audit["pop/s 1.wav"].n_channels == 2
    mono = (noise[1] * 32767).astype("<i2") / 32768
    parts = [rhythm.segment_vectors(mono[k * 2**16 : (k + 1) * 2**16], RATE, ("rp", "rh", "ssd", "mvd"), RhythmOptions()) for k in range(3)]
    stack = {t: np.stack([p[t] for p in parts]) for t in parts[0]}
    want = {
        "rp": np.median(stack["rp"], axis=0), "rh": np.median(stack["rh"], axis=0), "ssd": stack["ssd"].mean(axis=0),
        "mvd": stack["mvd"].mean(axis=0), "tssd": rhythm.row_moments(stack["ssd"].T).ravel(order="F"),
        "trh": rhythm.row_moments(stack["rh"].T).ravel(order="F"),
    }
    for t in types:
        got = {r.id: r[t] for r in result[t].collect()}
        assert set(got) == {"pop/s 0.wav", "pop/s 1.wav"} and np.allclose(got["pop/s 1.wav"], want[t], atol=1e-6), t
    stored = X.extract_features(spark, out, ["rp", "rh"], stored=True)
    assert stored["rp"].count() == 2
    wav(tmp_path / "in" / "new [1] {x}.wav", noise[0])
    for _ in range(2):
        X.extract_features(spark, str(tmp_path / "in"), ["rp", "rh"], out, append_new=True)
    assert sorted(r.id for r in spark.read.csv(f"{out}.rp").select(F.col("_c0").alias("id")).collect()) == ["new [1] {x}.wav", "pop/s 0.wav", "pop/s 1.wav"]
    (tmp_path / "list.txt").write_text("pop/s 0.wav\nnew [1] {x}.wav\npop/s 9.wav\n")
    listed = X.extract_features(spark, str(tmp_path / "list.txt"), ["rh"], path_prefix=str(tmp_path / "in"), label=True)
    assert sorted((r.id, r.id2) for r in listed["rh"].collect()) == [("new [1] {x}.wav", "in"), ("pop/s 0.wav", "pop")]
    assert [r.id for r in listed["errors"].collect()] == ["pop/s 9.wav"]
    (tmp_path / "in" / "pop" / "s 0.wav").rename(tmp_path / "in" / "song")
    first = str(tmp_path / "first")
    for source in (f"{tmp_path}/in/song", f"{tmp_path}/in/song", f"{tmp_path}/in/pop/s 1.wav"):
        X.extract_features(spark, source, ["rh"], first, suffixes=None, append_new=True, columnar=True)
    assert spark.read.parquet(f"{first}.rh.parquet").count() == 2
    labelled = X.media_files(spark, str(tmp_path / "in"), label=True).select("id", "id2").collect()
    assert ("pop/s 1.wav", "pop") in [tuple(r) for r in labelled]


def test_extraction_from_waveforms_with_segments(spark):
    samples = np.random.default_rng(3).uniform(-1, 1, 2**16).tolist()
    waves = spark.createDataFrame([("a", RATE, samples)], "id string, sample_rate int, samples array<double>")
    rows = X.extract_from_waveforms(waves, ["rh"], RhythmOptions(mod_ampl_limit=20), segments_only=True)
    row = segments.with_time(rows).first()
    assert (row.seg_no, row.first_sample, row.last_sample, len(row.vec)) == (0, 1, 2**16, 20)
    with pytest.raises(ValueError, match="unknown feature types"):
        X.base_types(["mel"])


def test_arrow_bound_is_restored(spark):
    from echorank.session import ARROW_ROWS, arrow_rows

    before = spark.conf.get(ARROW_ROWS)
    with arrow_rows(spark, 16):
        assert spark.conf.get(ARROW_ROWS) == "16"
    assert spark.conf.get(ARROW_ROWS) == before
