"""Waveforms → segments → segment features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rhythm import SEGMENT_SIZES, SEGMENT_TYPES, RhythmOptions, segment_vectors

# Fixed value: shorter recordings are analysed whole.
SHORT_SECONDS = 45

SEGMENT_FEATURES = "id string, sample_rate int, seg_no int, start long, feature_type string, vec array<double>, error string"
SEGMENT_FEATURES_ARROW = pa.schema(
    [
        ("id", pa.string()),
        ("sample_rate", pa.int32()),
        ("seg_no", pa.int32()),
        ("start", pa.int64()),
        ("feature_type", pa.string()),
        ("vec", pa.list_(pa.float64())),
        ("error", pa.string()),
    ]
)


def segment_plan(n_samples: int, rate: int, skip: int = 1, step: int = 1) -> list[int]:
    """Start samples (0-based) of the segments of one recording."""
    size = SEGMENT_SIZES.get(rate)
    if size is None:
        raise ValueError(f"a sample rate of {rate} is not supported")
    if n_samples / rate < SHORT_SECONDS and (skip > 0 or step > 1):
        skip, step = 0, 1
    count = ((n_samples - 2 * skip * size) // size - 1) // step + 1
    if count <= 0:
        raise ValueError(f"not enough data: {n_samples} samples, a segment takes {size}")
    return [(skip + n * step) * size for n in range(count)]


def _plan_columns(df: DataFrame, skip: int, step: int) -> DataFrame:
    size = F.try_element_at(F.create_map(*[F.lit(x) for pair in SEGMENT_SIZES.items() for x in pair]), F.col("sample_rate"))
    total = F.size("samples")
    short = total / F.col("sample_rate") < SHORT_SECONDS
    adjust = bool(skip > 0 or step > 1)
    skipped = F.when(short & adjust, 0).otherwise(skip)
    stepped = F.when(short & adjust, 1).otherwise(step)
    planned = df.withColumns({"_size": size, "_skip": skipped, "_step": stepped})
    usable = F.floor((total - F.col("_skip") * 2 * F.col("_size")) / F.col("_size"))
    return planned.withColumn("_count", (F.floor((usable - 1) / F.col("_step")) + 1).cast("int"))


def segment_signal(waves: DataFrame, skip: int = 1, step: int = 1) -> DataFrame:
    """``(id, sample_rate, seg_no, start, samples)`` of mono ``(id, sample_rate, samples)``.

    About 6 seconds each; ``start`` counts from 0. Longer recordings lose ``skip``
    segments at both ends. Items that give no segment are in ``segment_errors``.
    """
    planned = _plan_columns(waves, skip, step).where(F.col("_count") > 0)
    numbered = planned.withColumn("seg_no", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    start = (F.col("_skip") + F.col("seg_no") * F.col("_step")) * F.col("_size")
    return numbered.select(
        "id", "sample_rate", "seg_no", start.cast("long").alias("start"), F.slice("samples", start + 1, F.col("_size")).alias("samples")
    )


def segment_errors(waves: DataFrame, skip: int = 1, step: int = 1) -> DataFrame:
    """``(id, error)``: unsupported rate, or too short for one segment."""
    planned = _plan_columns(waves, skip, step)
    reason = F.when(
        F.col("_size").isNull(), F.concat(F.lit("unsupported sample rate "), F.col("sample_rate"))
    ).when(F.col("_count") <= 0, F.concat(F.lit("not enough data: "), F.size("samples"), F.lit(" samples")))
    return planned.select("id", reason.alias("error")).where(F.col("error").isNotNull())


def feature_batch(rows: Sequence[dict], types: Sequence[str], options: RhythmOptions) -> pa.RecordBatch:
    """Features of ``{id, sample_rate, seg_no, start, samples}`` rows as one batch."""
    out = []
    for row in rows:
        kept = {k: row[k] for k in ("id", "sample_rate", "seg_no", "start")}
        try:
            vectors = segment_vectors(np.asarray(row["samples"], dtype=float), row["sample_rate"], types, options)
            out += [{**kept, "feature_type": t, "vec": v, "error": None} for t, v in vectors.items()]
        except Exception as error:  # noqa: BLE001 - one bad segment must not stop the job
            out.append({**kept, "feature_type": None, "vec": None, "error": f"{type(error).__name__}: {error}"})
    return pa.RecordBatch.from_pylist(out, schema=SEGMENT_FEATURES_ARROW)


def segment_features(
    segments: DataFrame, types: Sequence[str] = ("rp", "rh"), options: RhythmOptions = RhythmOptions()
) -> DataFrame:
    """One row per segment and feature type. Segments stay in their partition.

    A segment is 0.5 to 2 MB: run this with few rows per Arrow batch, as
    ``session.materialize`` does for ``SEGMENT_ROWS``.
    """
    unknown = set(types) - set(SEGMENT_TYPES)
    if unknown:
        raise ValueError(f"no segment features: {sorted(unknown)}")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "sample_rate", "seg_no", "start")]
            samples = batch.column("samples")
            for n, values in enumerate(zip(*columns)):
                row = dict(zip(("id", "sample_rate", "seg_no", "start"), values))
                row["samples"] = samples[n].values.to_numpy(zero_copy_only=False)
                yield feature_batch([row], types, options)

    return segments.select("id", "sample_rate", "seg_no", "start", "samples").mapInArrow(extract, SEGMENT_FEATURES)


def with_time(features: DataFrame) -> DataFrame:
    """First and last sample (counted from 1) and their seconds, per segment."""
    size = F.element_at(F.create_map(*[F.lit(x) for pair in SEGMENT_SIZES.items() for x in pair]), F.col("sample_rate"))
    first: Column = F.col("start") + 1
    last: Column = F.col("start") + size
    return features.withColumns(
        {
            "first_sample": first,
            "last_sample": last,
            "first_second": first / F.col("sample_rate"),
            "last_second": last / F.col("sample_rate"),
        }
    )
