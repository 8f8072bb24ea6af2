"""Feature extraction: media files or waveforms to feature tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.ids import class_label, file_id
from ..functions.rhythm import SEGMENT_SIZES, SEGMENT_TYPES, RhythmOptions, row_moments, segment_vectors
from ..functions.spectral import resample
from ..operators.joins import anti_existing
from ..operators.moments import segment_mean, segment_median, segment_stats
from ..operators.segments import SEGMENT_FEATURES_ARROW, feature_batch, segment_features, segment_plan, segment_signal
from ..session import SEGMENT_ROWS, materialize
from ..sinks.columnar import write_columnar
from ..sinks.text import write_features_csv
from ..sources.lines import read_file_list
from ..sources.media import AUDIO_SUFFIXES, decode_pcm, media_files, scan_media, to_mono  # noqa: F401
from ..sources.stores import read_bytes
from ..sources.tables import load_features, read_features_csv, try_parquet

TYPES = ("rp", "ssd", "rh", "tssd", "trh", "mvd")
_BASE = {"tssd": "ssd", "trh": "rh"}

# A listing's rows are tiny, the work behind them is not: tasks it is dealt to at most, bytes of
# the files of a task, and tasks a core has for files of few bytes.
LISTING_TASKS, TASK_BYTES, TASKS_A_CORE = 10_000, 16 << 20, 4

FILE_FEATURES = (
    "id string, sample_rate int, seg_no int, start long, feature_type string, vec array<double>, error string, "
    "sample_width int, n_channels int, n_samples long"
)
RECORDING = pa.schema(
    [
        ("id", pa.string()),
        ("id2", pa.string()),
        ("feature_type", pa.string()),
        ("vec", pa.list_(pa.float64())),
        ("error", pa.string()),
        ("sample_rate", pa.int32()),
        ("sample_width", pa.int32()),
        ("n_channels", pa.int32()),
        ("n_samples", pa.int64()),
        ("segments", pa.int64()),
    ]
)


def base_types(types: Sequence[str]) -> list[str]:
    """The per-segment types a set of types needs."""
    unknown = set(types) - set(TYPES)
    if unknown:
        raise ValueError(f"unknown feature types: {sorted(unknown)}")
    needed = {_BASE.get(t, t) for t in types}
    return [t for t in SEGMENT_TYPES if t in needed]


def aggregate_features(segments: DataFrame, types: Sequence[str]) -> dict[str, DataFrame]:
    """``{type: (id, type)}`` from segment features.

    Medians for rp and rh, means for ssd and mvd, the seven statistics over the
    segments for tssd and trh.
    """
    good = segments.where(F.col("error").isNull())
    out = {}
    for name in types:
        rows = good.where(F.col("feature_type") == _BASE.get(name, name))
        if name in ("rp", "rh"):
            out[name] = segment_median(rows, ["id"], "vec", name)
        elif name in ("ssd", "mvd"):
            out[name] = segment_mean(rows, ["id"], "vec", name)
        else:
            out[name] = segment_stats(rows, ["id"], "vec", name)
    return out


def recording_vectors(
    mono: np.ndarray, rate: int, types: Sequence[str], options: RhythmOptions, skip: int, step: int
) -> tuple[dict[str, np.ndarray], int]:
    """The features of one recording and the number of its segments.

    Segments are analysed one after the other; only their vectors are kept, a few
    dozen in a song, and aggregated as ``aggregate_features`` does it. Other sampling
    rates than the three of the segments are converted first.
    """
    mono, rate = supported(mono, rate)
    wanted, starts = base_types(types), segment_plan(len(mono), rate, skip, step)
    parts = [segment_vectors(mono[a : a + SEGMENT_SIZES[rate]], rate, wanted, options) for a in starts]
    stack = {t: np.stack([p[t] for p in parts]) for t in wanted}
    out = {}
    for name in types:
        if name in _BASE:
            out[name] = row_moments(stack[_BASE[name]].T).ravel(order="F")
        else:
            out[name] = np.median(stack[name], axis=0) if name in ("rp", "rh") else stack[name].mean(axis=0)
    return out, len(starts)


def supported(mono: np.ndarray, rate: int) -> tuple[np.ndarray, int]:
    """The recording at a sampling rate that has segments: its own, else 22,050 or 44,100 Hz."""
    if rate in SEGMENT_SIZES:
        return mono, rate
    if rate <= 0:
        raise ValueError(f"a sample rate of {rate}")
    to = 22050 if rate < 22050 else 44100
    return resample(mono, rate, to), to


def _recording_rows(name: str, label: str | None, found: dict, about: dict) -> pa.RecordBatch:
    rows = [{"id": name, "id2": label, "feature_type": t, "vec": v, **about} for t, v in found.items()]
    return pa.RecordBatch.from_pylist(rows, schema=RECORDING)


def _failed(name: str, error: Exception) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"id": name, "error": f"{type(error).__name__}: {error}"}], schema=RECORDING)


def wave_features(
    waves: DataFrame,
    types: Sequence[str] = ("rp", "rh"),
    options: RhythmOptions = RhythmOptions(),
    skip_leadin_fadeout: int = 1,
    step_width: int = 1,
) -> DataFrame:
    """One row per mono waveform ``(id, sample_rate, samples)`` and type, or one with ``error``.

    A waveform is cut, analysed and aggregated in the task that has it; nothing but
    its features leaves it. Repeated ids are recordings of their own.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rate, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                try:
                    mono = np.asarray(samples.values, float)
                    found, n = recording_vectors(mono, rate, types, options, skip_leadin_fadeout, step_width)
                    yield _recording_rows(name, None, found, {"sample_rate": rate, "n_samples": len(mono), "segments": n})
                except Exception as error:  # noqa: BLE001 - one bad recording must not stop the job
                    yield _failed(name, error)

    return waves.select("id", "sample_rate", "samples").mapInArrow(extract, from_arrow_schema(RECORDING))


def file_features(
    files: DataFrame,
    types: Sequence[str] = ("rp", "rh"),
    options: RhythmOptions = RhythmOptions(),
    skip_leadin_fadeout: int = 1,
    step_width: int = 1,
) -> DataFrame:
    """One row per file and type, or one with ``error``.

    ``files`` is ``(id, content)``, or a listing ``(id, path)`` whose files the tasks
    open one at a time; ``id2`` is passed on. A song never leaves its task.
    """
    source = "content" if "content" in files.columns else "path"
    label = F.col("id2") if "id2" in files.columns else F.lit(None).cast("string").alias("id2")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, second, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                try:
                    content = place.as_buffer().to_pybytes() if source == "content" else read_bytes(place.as_py())
                    rate, width, samples = decode_pcm(content)
                    mono = to_mono(samples, width)
                    found, n = recording_vectors(mono, rate, types, options, skip_leadin_fadeout, step_width)
                    about = {"sample_rate": rate, "sample_width": width, "n_channels": samples.shape[1], "n_samples": len(samples)}
                    yield _recording_rows(name, second, found, {**about, "segments": n})
                except Exception as error:  # noqa: BLE001 - one bad file must not stop the job
                    yield _failed(name, error)

    return files.select("id", label, source).mapInArrow(extract, from_arrow_schema(RECORDING))


def feature_tables(rows: DataFrame, types: Sequence[str], label: bool = False) -> dict[str, DataFrame]:
    """``{type: (id[, id2], type)}`` of the rows of ``wave_features`` or ``file_features``."""
    ids = ["id", "id2"] if label else ["id"]
    return {t: rows.where(F.col("feature_type") == t).select(*ids, F.col("vec").alias(t)) for t in types}


def extract_from_waveforms(
    waves: DataFrame,
    types: Sequence[str] = ("rp", "rh"),
    options: RhythmOptions = RhythmOptions(),
    skip_leadin_fadeout: int = 1,
    step_width: int = 1,
    segments_only: bool = False,
) -> dict[str, DataFrame] | DataFrame:
    """Features of mono waveforms ``(id, sample_rate, samples)``, written once.

    ``segments_only`` gives the features of the single segments instead.
    """
    if segments_only:
        segments = segment_signal(waves, skip_leadin_fadeout, step_width)
        return materialize(segment_features(segments, base_types(types), options), "segment-features", SEGMENT_ROWS)
    rows = wave_features(waves, types, options, skip_leadin_fadeout, step_width)
    return feature_tables(materialize(rows, "wave-features", SEGMENT_ROWS), types)


def file_segment_features(
    files: DataFrame,
    types: Sequence[str] = ("rp", "rh"),
    options: RhythmOptions = RhythmOptions(),
    skip_leadin_fadeout: int = 1,
    step_width: int = 1,
) -> DataFrame:
    """Segment features of ``(id, content)`` rows, decoded in the same task.

    A song never leaves its task: it is decoded, averaged to mono and cut there,
    one segment at a time, and only feature vectors come out. A file that cannot
    be decoded gives one row with ``error``. Files are large: write the result with
    ``materialize(…, rows=SEGMENT_ROWS)``, as ``extract_features`` does.
    """
    wanted = base_types(types)

    def rows_of(name: str, content: bytes) -> Iterator[pa.RecordBatch]:
        rate, width, samples = decode_pcm(content)
        mono, rate = supported(to_mono(samples, width), rate)
        about = [pa.scalar(width, pa.int32()), pa.scalar(samples.shape[1], pa.int32()), pa.scalar(len(samples), pa.int64())]
        for n, start in enumerate(segment_plan(len(mono), rate, skip_leadin_fadeout, step_width)):
            end = start + SEGMENT_SIZES[rate]
            row = {"id": name, "sample_rate": rate, "seg_no": n, "start": start, "samples": mono[start:end]}
            batch = feature_batch([row], wanted, options)
            yield _widen(batch, about)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist()):
                try:
                    yield from rows_of(name, content)
                except Exception as error:  # noqa: BLE001 - one bad file must not stop the job
                    yield _error_row(name, error)

    return files.select("id", "content").mapInArrow(extract, FILE_FEATURES)


_ABOUT = ("sample_width", "n_channels", "n_samples")


def _widen(batch: pa.RecordBatch, about: Sequence[pa.Scalar]) -> pa.RecordBatch:
    columns = [pa.repeat(value, len(batch)) for value in about]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *_ABOUT])


def _error_row(name: str, error: Exception) -> pa.RecordBatch:
    row = {"id": name, "error": f"{type(error).__name__}: {error}"}
    batch = pa.RecordBatch.from_pylist([row], schema=SEGMENT_FEATURES_ARROW)
    nulls = [pa.scalar(None, kind) for kind in (pa.int32(), pa.int32(), pa.int64())]
    return _widen(batch, nulls)


def list_recordings(
    spark: SparkSession, source: str, suffixes: Sequence[str] | None = AUDIO_SUFFIXES, path_prefix: str | None = None
) -> DataFrame:
    """``(id, id2, path, length)`` of what ``source`` names: a folder, a ``.txt`` list or one file.

    The bytes of a file are NULL in a list, whose files are not opened. Ids are relative to a folder, and as written for a list or a file; ``id2`` is the
    class, the folder a file lies in. Relative names of a list get ``path_prefix``.
    ``suffixes=None`` takes files of every kind.
    """
    if source.lower().endswith(".txt"):
        named = read_file_list(spark, source).select(F.col("path").alias("name"))
        prefix = F.lit(f"{path_prefix.rstrip('/')}/" if path_prefix else "")
        path = F.when(F.col("name").startswith("/"), F.col("name")).otherwise(F.concat(prefix, "name"))
        listed = named.select("name", path.alias("path"), F.lit(None).cast("long").alias("length"))
    else:
        # Spark plans a task for a few dozen files, as if it had to read them.
        files = scan_media(spark, source, suffixes).select("path", "length").coalesce(spread(spark))
        root = f"{source.rstrip('/')}/"
        inside = F.when(F.col("path").startswith(root), F.substring("path", F.lit(len(root) + 1), F.length("path"))).otherwise(F.col("path"))
        listed = files.select(inside.alias("name"), "path", "length")
    return listed.select(file_id("name").alias("id"), class_label("path").alias("id2"), "path", "length")


def spread(spark: SparkSession) -> int:
    """Tasks of a list of small files."""
    cores = spark.sparkContext.defaultParallelism if hasattr(spark, "_jsc") else 64  # a Connect session does not tell
    return TASKS_A_CORE * cores


def deal_listing(listed: DataFrame) -> tuple[DataFrame, int]:
    """The files of a listing in tasks of about ``TASK_BYTES``, and their number.

    Each of a few small files, or of unknown size, is a task of its own as long as there are cores.
    """
    spark = listed.sparkSession
    count, size = listed.agg(F.count(F.lit(1)), F.sum(F.coalesce("length", F.lit(TASK_BYTES)))).first()
    tasks = max(-(-int(size or 0) // TASK_BYTES), spread(spark))
    return listed.repartition(max(1, min(count, tasks, LISTING_TASKS))), count


def _stored_ids(spark: SparkSession, stub: str, name: str, columnar: bool) -> DataFrame | None:
    """The ids that the output holds, None before the first run."""
    if columnar:
        held = try_parquet(spark, f"{stub}.{name}.parquet")
        return held.select("id") if held is not None else None
    try:
        return read_features_csv(spark, f"{stub}.{name}", ids_only=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def extract_features(
    spark: SparkSession,
    source: str,
    types: Sequence[str] = ("rp", "rh"),
    out_stub: str | None = None,
    suffixes: Sequence[str] | None = AUDIO_SUFFIXES,
    options: RhythmOptions = RhythmOptions(),
    skip_leadin_fadeout: int = 1,
    step_width: int = 1,
    append_new: bool = False,
    stored: bool = False,
    append: bool = False,
    label: bool = False,
    columnar: bool = False,
    path_prefix: str | None = None,
) -> Mapping[str, DataFrame]:
    """The batch job: list, decode, cut, extract, aggregate, write.

    ``source`` is a folder, a ``.txt`` list of files or one file (``list_recordings``).
    Returns the feature tables plus ``audit`` and ``errors``. With ``out_stub`` they
    are written as CSV, or as Parquet with ``columnar``; ``append`` adds to what is
    there, ``append_new`` only items that the first type does not hold yet. ``label``
    makes the class a second id. With ``stored`` the source is a feature set.

    The listing stays a table: new files are found by an anti-join, and the tasks open
    the files they get.
    """
    if stored:
        return load_features(spark, source, types)
    listed = list_recordings(spark, source, suffixes, path_prefix)
    if append_new:
        if not out_stub:
            raise ValueError("append_new needs out_stub")
        held = _stored_ids(spark, out_stub, types[0], columnar)
        listed = listed if held is None else anti_existing(listed, held)
    files, count = deal_listing(materialize(listed, "listing"))
    rows = file_features(files, types, options, skip_leadin_fadeout, step_width)
    raw = materialize(rows, "file-features", SEGMENT_ROWS)
    tables: dict[str, DataFrame] = feature_tables(raw, types, label)
    if out_stub and count:
        if columnar:
            write_columnar(tables, out_stub, append=append or append_new)
        else:
            write_features_csv(tables, out_stub, append=append or append_new)
    good = raw.where(F.col("error").isNull() & (F.col("feature_type") == types[0]))
    audit = good.select("id", "sample_rate", *_ABOUT, "segments")
    return {**tables, "audit": audit, "errors": raw.where("error IS NOT NULL").select("id", "error").distinct()}
