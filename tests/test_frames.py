"""Resampling, cepstra, chroma, beats and keys on planted signals."""

import io
import wave

import numpy as np
import pytest

from echorank.functions import spectral as S
from echorank.functions.pitch import PITCHES
from echorank.plans import frames as A
from echorank.plans.extraction import feature_tables, file_features
from echorank.plans.ranking import rank_full

OPTIONS = A.FrameOptions(rate=11025, cepstra=(512, 256), chroma=(2048, 1024), onsets=(256, 128))


@pytest.mark.parametrize("rate, to", [(48000, 44100), (8000, 22050), (96000, 44100), (22050, 11025), (44056, 44100), (11025, 11025)])
def test_resampled_tones_keep_frequency_and_level(rate, to):
    for hertz in (50.0, 997.0, 3100.0):
        x = 0.5 * np.sin(2 * np.pi * hertz * np.arange(rate) / rate)
        y = S.resample(x, rate, to)
        assert len(y) == to
        want = 0.5 * np.sin(2 * np.pi * hertz * np.arange(to) / to)
        assert np.abs(y - want)[to // 10 : -to // 10].max() < 1e-4


def test_resampling_filters_what_does_not_fit():
    x = np.sin(2 * np.pi * 15000 * np.arange(48000) / 48000)
    assert np.abs(S.resample(x, 48000, 22050))[500:-500].max() < 1e-3
    assert len(S.resample(np.zeros(0), 8000, 22050)) == 0 and S.resample(np.ones(1), 8000, 22050).shape == (3,)


def test_bands_and_transform():
    mel = S.mel_matrix(2048, 44100)
    assert mel.shape == (40, 1025) and (mel >= 0).all() and (mel.sum(axis=1) > 0).all()
    assert np.allclose(S._hertz(S._mel(np.array([0.0, 440.0, 1000.0, 9000.0]))), [0, 440, 1000, 9000])
    turn = S.cosine_matrix(40, 40)
    assert np.allclose(turn @ turn.T, np.eye(40))
    assert S.cepstra(np.ones(10), 11025, 512, 256).shape == (1, 13)


def chord(key, minor, seconds=1.0, rate=11025):
    t = np.arange(int(seconds * rate)) / rate
    return sum(np.sin(2 * np.pi * 220 * 2 ** ((key + s) / 12) * t) for s in (0, 3 if minor else 4, 7, 12)) / 5


def clicks(bpm, seconds=14, rate=11025):
    t = np.arange(seconds * rate) / rate
    return np.exp(-(t % (60 / bpm)) * 60) * np.sin(2 * np.pi * 1500 * t)


@pytest.mark.parametrize("bpm", [62, 90, 120, 133])
def test_clicks(bpm):
    onsets, rate = S.onset_strength(clicks(bpm), 11025, 256, 128), 11025 / 128
    found = S.tempo(onsets, rate)
    assert found == pytest.approx(bpm, rel=0.02)
    steps = np.diff(S.beat_frames(onsets, rate, found)) / rate
    assert np.abs(steps * bpm / 60 - 1).max() < 0.1 and len(steps) >= 14 * bpm / 60 - 4


def test_no_beats_in_silence_and_short_recordings():
    for x in (np.zeros(50_000), np.zeros(3), np.ones(2000)):
        onsets = S.onset_strength(x, 11025, 256, 128)
        assert S.tempo(onsets, 86.0) is None
    assert len(S.beat_frames(np.zeros(100), 86.0, 120.0)) == 0
    assert not S.pitch_classes(np.zeros(5000), 11025, 2048, 1024).any()


def waves(spark, rows):
    return spark.createDataFrame([(i, r, [float(v) for v in x]) for i, r, x in rows], "id string, sample_rate int, samples array<double>")


def test_keys_of_chords(spark):
    rows = [(f"{PITCHES[k]} {'minor' if m else 'major'}", 11025, chord(k, m)) for k in range(12) for m in (0, 1)] + [("silent", 11025, np.zeros(3000))]
    found = A.item_keys(A.recording_frames(waves(spark, rows), ["chroma"], OPTIONS)).collect()
    assert len(found) == 24 and all(r.id == f"{r.key} {r.scale}" and 0.6 < r.strength <= 1 for r in found)


def wav(x, rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.repeat((x * 20000).astype("<i2"), 2).tobytes())
    return out.getvalue()


def test_files_of_other_rates_have_features(spark):
    t = lambda rate: np.arange(8 * rate) / rate
    files = [(f"r{rate}", wav(np.sin(2 * np.pi * 600 * t(rate)) * (1 + np.sin(2 * np.pi * 4 * t(rate))) / 3, rate)) for rate in (22050, 16000, 8000, 48000)]
    rows = file_features(spark.createDataFrame([*files, ("bad", b"x")], "id string, content binary"), ["ssd", "rh"])
    assert [r.id for r in rows.where("error IS NOT NULL").collect()] == ["bad"]
    assert {r.id: r.sample_rate for r in rows.where("error IS NULL").collect()} == {f"r{r}": r for r in (22050, 16000, 8000, 48000)}
    rh = {r.id: np.array(r.rh) for r in feature_tables(rows, ["rh"])["rh"].collect()}
    for name in ("r16000", "r8000"):
        assert np.argmax(rh[name]) == np.argmax(rh["r22050"]) and np.corrcoef(rh[name], rh["r22050"])[0, 1] > 0.95


def test_recordings_become_a_catalogue(spark):
    """From waves to the tables of a ranking: keys are turned to A, so equal songs in other keys are near."""
    def song(key, bpm):
        t = np.arange(11025 * 12) / 11025
        beat = np.exp(-(t % (60 / bpm)) * 20)
        root = key + np.array([0, 5, 7, 0])[(t // 1.5).astype(int) % 4]
        return sum(np.sin(2 * np.pi * 220 * 2 ** ((root + s) / 12) * t) for s in (0, 4, 7)) * beat / 4

    rows = [("a", 11025, song(0, 100)), ("moved", 11025, song(3, 100)), ("fast", 11025, song(1, 140)), ("noise", 11025, np.full(5, np.nan))]
    tables = A.catalogue_from_recordings(waves(spark, rows), OPTIONS)
    assert [(r.id, "no numbers" in r.error) for r in tables["errors"].collect()] == [("noise", True)]
    notes = {r.id: r for r in tables["notes"].collect()}
    assert {(r.id, r.key, r.scale) for r in notes.values()} == {("a", "A", "major"), ("moved", "C", "major"), ("fast", "A#", "major")}
    assert set(notes["a"].notes) <= set("ABCDEFGHIJKL") and len(notes["a"].notes) > 10
    bpm = {r.id: (r.bpm, len(r.bh)) for r in tables["bh"].collect()}
    assert bpm["a"][0] == pytest.approx(100, rel=0.05) and bpm["a"][1] == 250
    assert {len(r.mfcc) for r in tables["mfcc"].collect()} == {182}
    assert all(len(r.chroma) % 12 == 0 for r in tables["chroma"].collect())
    ranked = rank_full(tables, "a", ("mfcc", "notes", "bh", "chroma")).collect()
    assert [r.id for r in ranked][:2] == ["a", "moved"]


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        A.recording_frames(waves(spark, []), ["loudness"])
    assert A.recording_frames(waves(spark, [])).count() == 0
