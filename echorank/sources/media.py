"""Media files: listing and WAV decoding."""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import class_label, file_id

# The suffixes scanned by default.
AUDIO_SUFFIXES = (".wav", ".mp3")

WAVEFORM = (
    "path string, sample_rate int, sample_width int, n_channels int, n_samples long, "
    "samples array<array<double>>, error string"
)


def _reader(spark: SparkSession, types: str | Sequence[str] | None):
    """A binary reader that lists only wanted suffixes, compared without case."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if types is None:
        return reader
    return reader.option("pathGlobFilter", suffix_glob(types))


def suffix_glob(types: str | Sequence[str]) -> str:
    """A file name pattern for suffixes, compared without case."""
    types = [types] if isinstance(types, str) else types
    either = lambda c: f"[{c.lower()}{c.upper()}]" if c.isalpha() else c
    return "*{" + ",".join("".join(map(either, t)) for t in types) + "}"


def local_name(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def below(path: Column, root: str) -> Column:
    return F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))


def scan_media(
    spark: SparkSession,
    path: str,
    types: str | Sequence[str] | None = AUDIO_SUFFIXES,
    relative: bool = False,
    ignore_hidden: bool = True,
) -> DataFrame:
    """``(path, length, modificationTime)`` of media files below ``path``.

    Suffixes are compared without case; ``types=None`` takes every file. Spark
    itself never lists names that start with ``_`` or ``.``, nor empty files.
    """
    files = _reader(spark, types).load(path).drop("content").withColumn("path", local_name(F.col("path")))
    if ignore_hidden:
        files = files.where(~F.substring_index("path", "/", -1).startswith("."))
    return files.withColumn("path", below(F.col("path"), path)) if relative else files


def media_files(
    spark: SparkSession,
    root: str,
    types: str | Sequence[str] | None = AUDIO_SUFFIXES,
    paths: Sequence[str] | None = None,
    compat_ids: bool = False,
    label: bool = False,
) -> DataFrame:
    """``(id, content[, id2])`` of the media below ``root``; ids are relative to it.

    ``paths`` names the files to read. Suffixes and paths are settled when files
    are listed, so no other file is opened and no content goes through a join.
    """
    if paths is not None and not paths:
        return spark.createDataFrame([], "id string, content binary" + (", id2 string" if label else ""))
    literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths] if paths is not None else root
    files = _reader(spark, types).load(literal)
    inside = below(local_name(F.col("path")), root)
    columns = [file_id(inside, compat_ids).alias("id"), F.col("content")]
    return files.select(*columns, *([class_label(inside).alias("id2")] if label else []))


def decode_pcm(content: bytes) -> tuple[int, int, np.ndarray]:
    """``(rate, width, samples[n, channels])`` of one RIFF file.

    8 bit is unsigned, wider samples are signed; 24 bit is widened with its sign.
    """
    if not content:
        raise ValueError("empty file")
    with wave.open(io.BytesIO(content)) as wav:
        rate, width, channels = wav.getframerate(), wav.getsampwidth(), wav.getnchannels()
        data = wav.readframes(wav.getnframes())
    if width > 4:
        raise ValueError(f"samples of {width} bytes")
    if len(data) % (width * channels):
        raise ValueError("data is no whole number of samples")
    if width == 3:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3)
        high = np.zeros((len(parts), 4), np.uint8)
        high[:, 1:] = parts
        flat = high.view("<i4").ravel() >> 8
    else:
        flat = np.frombuffer(data, np.uint8 if width == 1 else f"<i{width}")
    return rate, width, flat.reshape(-1, channels)


def to_mono(samples: np.ndarray, width: int) -> np.ndarray:
    """The mean of the channels, in about (-1, 1)."""
    return (samples[:, 0] if samples.shape[1] == 1 else samples.mean(axis=1)) / 2.0 ** (8 * width - 1)


def decode_wav(files: DataFrame) -> DataFrame:
    """``(path, content)`` → waveform rows; a bad file gives a row with ``error``.

    A waveform is a whole recording in one row. ``extraction.file_segment_features``
    goes from file to features without it.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rate, width, samples = decode_pcm(content)
                    n, channels = samples.shape
                    flat = pa.array(np.ascontiguousarray(samples, float).ravel())
                    frames = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * channels, flat)
                    about = [path, rate, width, channels, n]
                    columns = [pa.array([v], t) for v, t in zip(about, _WAVEFORM_ARROW.types)]
                    columns += [pa.ListArray.from_arrays(np.array([0, n], np.int32), frames), pa.array([None], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, schema=_WAVEFORM_ARROW)
                except Exception as error:  # noqa: BLE001 - one bad file must not stop the job
                    row = {"path": path, "error": f"{type(error).__name__}: {error}"}
                    yield pa.RecordBatch.from_pylist([row], schema=_WAVEFORM_ARROW)

    return files.select("path", "content").mapInArrow(decode, WAVEFORM)


_WAVEFORM_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("sample_rate", pa.int32()),
        ("sample_width", pa.int32()),
        ("n_channels", pa.int32()),
        ("n_samples", pa.int64()),
        ("samples", pa.list_(pa.list_(pa.float64()))),
        ("error", pa.string()),
    ]
)
