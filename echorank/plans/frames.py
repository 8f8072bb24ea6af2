"""Recordings to the tables a catalogue is made of: timbre, chroma, notes, tempo and key.

Stages with tables between them. A recording is decoded and analysed in the task that has
it and leaves as rows of frames; those are written once. Models, beat means, tempo
histograms and keys are Spark aggregates over the frames, and beats a path through one
item's onsets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import spectral as S
from ..functions.pitch import PITCHES, encode_pitch_array, transpose_chroma, transpose_notes
from ..operators.beats import HOP, PITCH_BINS, SAMPLE_RATE, beat_chroma, beat_frame, beat_notes, chroma_matrix, note_sequence, tempo_histogram
from ..operators.models import gaussian_model
from ..session import SEGMENT_ROWS, materialize
from ..sources.media import decode_pcm, to_mono

KINDS = ("cepstra", "chroma", "onsets")
FRAMES = pa.schema([("id", pa.string()), ("kind", pa.string()), ("frame", pa.int32()), ("v", pa.list_(pa.float64())), ("error", pa.string())])
BEATS = pa.schema([("id", pa.string()), ("bpm", pa.float64()), ("beats", pa.list_(pa.float64()))])
# How well each pitch fits a major and a minor key, from the key's own pitch up.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


@dataclass(frozen=True)
class FrameOptions:
    """Sampling rate of the analysis, and frame size and hop of each kind."""

    rate: int = SAMPLE_RATE
    cepstra: tuple[int, int] = (2048, 1024)
    chroma: tuple[int, int] = (2 * HOP, HOP)
    onsets: tuple[int, int] = (1024, 512)


def _rows(name: str, kind: str, values: np.ndarray) -> pa.RecordBatch:
    n, width = values.shape
    vectors = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(values.ravel()))
    columns = [pa.repeat(name, n), pa.repeat(kind, n), pa.array(np.arange(n, dtype=np.int32)), vectors, pa.nulls(n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=FRAMES)


def recording_frames(recordings: DataFrame, kinds: Sequence[str] = KINDS, options: FrameOptions = FrameOptions()) -> DataFrame:
    """``id, kind, frame, v, error`` of files ``(id, content)`` or mono waves ``(id, sample_rate, samples)``.

    Cepstra have 13 numbers a frame, chroma 12 pitch classes from A; the onsets of a
    recording are one row. Other sampling rates are converted first. A recording that
    cannot be read is one row with ``error``. Write the result with
    ``materialize(…, rows=SEGMENT_ROWS)``: recordings are large, rows are not.
    """
    unknown = set(kinds) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds of frames: {sorted(unknown)}")
    from_files = "content" in recordings.columns

    def analysed(name: str, mono: np.ndarray, rate: int, filters: dict) -> Iterator[pa.RecordBatch]:
        x = S.resample(mono, rate, options.rate, filters)
        if "cepstra" in kinds:
            yield _rows(name, "cepstra", S.cepstra(x, options.rate, *options.cepstra))
        if "chroma" in kinds:
            yield _rows(name, "chroma", S.pitch_classes(x, options.rate, *options.chroma))
        if "onsets" in kinds:
            yield _rows(name, "onsets", S.onset_strength(x, options.rate, *options.onsets)[None, :])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {}
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                try:
                    if from_files:
                        rate, width, samples = decode_pcm(batch.column(1)[i].as_buffer().to_pybytes())
                        mono = to_mono(samples, width)
                    else:
                        rate, mono = batch.column(1)[i].as_py(), np.asarray(batch.column(2)[i].values, float)
                    if not np.isfinite(mono).all():
                        raise ValueError("samples that are no numbers")
                    yield from list(analysed(name, mono, rate, filters))
                except Exception as error:  # noqa: BLE001 - one bad recording must not stop the job
                    yield pa.RecordBatch.from_pylist([{"id": name, "error": f"{type(error).__name__}: {error}"}], schema=FRAMES)

    columns = ["id", "content"] if from_files else ["id", "sample_rate", "samples"]
    return recordings.select(*columns).mapInArrow(extract, from_arrow_schema(FRAMES))


def of_kind(frames: DataFrame, kind: str) -> DataFrame:
    return frames.where(F.col("kind") == kind).select("id", "frame", "v")


def item_beats(frames: DataFrame, options: FrameOptions = FrameOptions()) -> DataFrame:
    """``id, bpm, beats``: tempo and beat times in seconds, from the onsets of each item.

    Items without a repetition have no tempo (NULL) and no beats.
    """
    per_second = options.rate / options.onsets[1]

    def track(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, onsets in zip(batch.column(0).to_pylist(), batch.column(1)):
                strength = np.asarray(onsets.values, float)
                bpm = S.tempo(strength, per_second)
                beats = [] if bpm is None else (S.beat_frames(strength, per_second, bpm) / per_second).tolist()
                rows.append({"id": name, "bpm": bpm, "beats": beats})
            yield pa.RecordBatch.from_pylist(rows, schema=BEATS)

    return of_kind(frames, "onsets").select("id", "v").mapInArrow(track, from_arrow_schema(BEATS))


def beat_table(beats: DataFrame) -> DataFrame:
    """``id, t, frame``: a row per beat, with the chroma frame it falls on."""
    return beats.select("id", F.explode("beats").alias("t")).withColumn("frame", beat_frame("t"))


def _correlation(x: Sequence[Column], profile: np.ndarray) -> Column:
    weights = (profile - profile.mean()) / np.linalg.norm(profile - profile.mean())
    total = F.lit(0.0)
    for column, weight in zip(x, weights):
        total = total + column * F.lit(float(weight))
    return total


def item_keys(frames: DataFrame) -> DataFrame:
    """``id, key, scale, strength``: the key whose profile fits the mean chroma best.

    Means are mergeable sums. ``strength`` is the correlation; an item whose pitches are
    all alike, or silent, has no key and no row. Ties go to the key nearer to A, major first.
    """
    means = of_kind(frames, "chroma").groupBy("id").agg(*[F.avg(F.col("v")[i]).alias(f"c{i}") for i in range(PITCH_BINS)])
    x = [F.col(f"c{i}") for i in range(PITCH_BINS)]
    mean = sum(x, F.lit(0.0)) / PITCH_BINS
    spread = F.sqrt(sum([(c - mean) * (c - mean) for c in x], F.lit(0.0)))
    fits = [
        F.struct(_correlation(x, np.roll(profile, k)).alias("fit"), F.lit(-2 * k - n).alias("order"), F.lit(PITCHES[k]).alias("key"), F.lit(scale).alias("scale"))
        for k in range(PITCH_BINS)
        for n, (scale, profile) in enumerate((("major", np.array(MAJOR)), ("minor", np.array(MINOR))))
    ]
    best = means.select("id", spread.alias("spread"), F.array_max(F.array(*fits)).alias("best")).where("spread > 1e-9")
    return best.select("id", "best.key", "best.scale", (F.col("best.fit") / F.col("spread")).alias("strength"))


def catalogue_from_recordings(
    recordings: DataFrame, options: FrameOptions = FrameOptions()
) -> dict[str, DataFrame]:
    """The feature tables ``mfcc``, ``chroma``, ``notes`` and ``bh`` of a ranking, and ``errors``.

    Frames and beats are written once. Chroma and notes are turned to the key of A; items
    without a key are left out there.
    """
    frames = materialize(recording_frames(recordings, KINDS, options), "frames", SEGMENT_ROWS)
    beats = materialize(item_beats(frames, options), "beats")
    table, keys, chroma = beat_table(beats), item_keys(frames), of_kind(frames, "chroma")
    matrix = chroma_matrix(beat_chroma(chroma, table)).join(keys, "id")
    notes = note_sequence(beat_notes(chroma, table)).join(keys, "id")
    return {
        "mfcc": gaussian_model(of_kind(frames, "cepstra"), S.CEPSTRA).select("id", "mfcc"),
        "chroma": matrix.select("id", transpose_chroma("key", "chroma").alias("chroma")),
        "notes": notes.select("id", "key", "scale", encode_pitch_array(transpose_notes("key", "pitches")).alias("notes")),
        "bh": tempo_histogram(table),
        "errors": frames.where("error IS NOT NULL").select("id", "error"),
    }
