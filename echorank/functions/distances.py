"""Distances between two columns of one row, as native expressions.

These serve any pair table. A catalogue against named queries goes through
``operators.pairing``, which sends every vector to an Arrow batch once for all
queries instead of once per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ids import as_column
from .vectors import diagonal, euclidean_model_vector, model_covariance, model_mean


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def euclidean(x, q) -> Column:
    return F.sqrt(_sum(F.zip_with(as_column(x), as_column(q), lambda a, b: (a - b) * (a - b))))


def euclidean_mfcc(x, q, d: int = 13) -> Column:
    """Euclidean over means and the upper covariance triangle."""
    return euclidean(euclidean_model_vector(x, d), euclidean_model_vector(q, d))


def levenshtein(x, q) -> Column:
    return F.levenshtein(as_column(x), as_column(q))


def sym_kl(x, q, x_terms, q_terms, d: int = 13) -> Column:
    """Symmetric Kullback-Leibler on the diagonals of covariance and inverse.

    ``*_terms`` come from ``gaussian.gaussian_terms``. A singular side gives
    +inf, which ``finite`` drops later.
    """
    x, q, x_terms, q_terms = map(as_column, (x, q, x_terms, q_terms))
    c1, c2 = diagonal(model_covariance(x, d), d), diagonal(model_covariance(q, d), d)
    i1, i2 = x_terms["diag_inv"], q_terms["diag_inv"]
    gap = F.zip_with(model_mean(x, d), model_mean(q, d), lambda a, b: (a - b) * (a - b))
    crossed = _sum(F.zip_with(c1, i2, lambda a, b: a * b)) + _sum(F.zip_with(c2, i1, lambda a, b: a * b))
    shifted = _sum(F.zip_with(F.zip_with(i1, i2, lambda a, b: a + b), gap, lambda i, m: i * m))
    divergence = (crossed + shifted - 2.0 * d) / 4
    return F.when(x_terms["invertible"] & q_terms["invertible"], divergence).otherwise(float("inf"))
