"""Arrow list columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


WAVES = "id string, sample_rate int, samples array<double>"


def wave_batch(name: str, rate: int, samples: pa.Array | None) -> pa.RecordBatch:
    """One recording as a batch of its own, for it is large; unknown samples are NULL."""
    if samples is None:
        column = pa.nulls(1, pa.list_(pa.float64()))
    else:
        column = pa.ListArray.from_arrays(np.array([0, len(samples)], np.int32), samples)
    return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([rate], pa.int32()), column], ["id", "sample_rate", "samples"])


def null_index(values: pa.Array) -> pa.Array | None:
    """For each row its place among the rows that are not NULL; None without NULLs.

    A nullable Arrow take with it puts results back, NULL rows staying NULL.
    """
    if not values.null_count:
        return None
    valid = np.asarray(values.is_valid())
    return pa.array(np.where(valid, np.cumsum(valid) - 1, 0), mask=~valid)


def restore(index: pa.Array | None, values: pa.Array) -> pa.Array:
    return values if index is None else values.take(index)


def matrix_of(vectors: pa.Array) -> tuple[pa.Array | None, np.ndarray]:
    """``(null_index, matrix)`` of an ``ARRAY<DOUBLE>`` column, NULL rows left out."""
    index, vectors = null_index(vectors), vectors.drop_null()
    if len(vectors) == 0:
        return index, np.zeros((0, 2))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width, rest = divmod(len(flat), len(vectors))
    if rest or not (vectors.value_lengths().to_numpy(zero_copy_only=False) == width).all():
        raise ValueError("vectors of one feature must have one length")
    return index, flat.astype(float, copy=False).reshape(len(vectors), width)


def ragged_matrices(vectors: pa.Array, rows: int) -> tuple[pa.Array | None, list[np.ndarray]]:
    """Row-major matrices of ``rows`` rows and any width; NULLs as in ``matrix_of``."""
    index, vectors = null_index(vectors), vectors.drop_null()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
    return index, [piece.reshape(rows, -1) for piece in np.split(flat, ends)[: len(vectors)]]
