"""Per-model terms of the Gaussian distances, computed once per item."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from .arrow import matrix_of, restore
from .ids import as_column
from .kernels import GaussianBatch

TERMS = T.StructType(
    [
        T.StructField("diag_inv", T.ArrayType(T.DoubleType())),
        T.StructField("log_det", T.DoubleType()),
        T.StructField("invertible", T.BooleanType()),
    ]
)


@F.arrow_udf(TERMS)
def _terms(models: pa.Array) -> pa.Array:
    index, matrix = matrix_of(models)
    batch = GaussianBatch(matrix)
    batch.invert()
    batch.log_dets()
    rows = pa.StructArray.from_arrays(
        [pa.array(list(batch.diag_inv), pa.list_(pa.float64())), pa.array(batch.log_det), pa.array(batch.invertible)],
        names=["diag_inv", "log_det", "invertible"],
    )
    return restore(index, rows)


def gaussian_terms(model) -> Column:
    """``diag_inv``, ``log_det`` and ``invertible`` of a mean-covariance vector.

    ``invertible`` is full numeric rank. Store the column with the features and
    ``distances.sym_kl`` needs no Python at query time.
    """
    return _terms(as_column(model))


def is_invertible(model) -> Column:
    return gaussian_terms(model)["invertible"]
