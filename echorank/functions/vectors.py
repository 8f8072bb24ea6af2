"""Expressions on ``ARRAY<DOUBLE>`` feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ids import as_column


def parse_vector(text) -> Column:
    """``[1., 2.5, [3]]`` → doubles. A malformed number makes the vector NULL."""
    numbers = F.split(F.translate(as_column(text), "[] ", ""), ",").try_cast("array<double>")
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def format_vector(vec, decimals: int | None = 8) -> Column:
    """``[a,b,c]`` in fixed-point notation; with ``decimals=None`` every digit
    needed to read the same doubles back, small ones with an exponent.
    """
    numbers = as_column(vec)
    if decimals is None:
        texts = numbers.cast("array<string>")
    else:
        texts = F.transform(numbers, lambda x: F.format_string(f"%.{decimals}f", x))
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def format_matrix(vec, rows: int | Column, decimals: int | None = 8) -> Column:
    """A row-major matrix of ``rows`` rows as ``[[..],[..]]``."""
    vec, rows = as_column(vec), rows if isinstance(rows, Column) else F.lit(rows)
    width = (F.size(vec) / rows).cast("int")
    lines = F.transform(
        F.sequence(F.lit(0), rows - 1), lambda r: format_vector(F.slice(vec, r * width + 1, width), decimals)
    )
    return F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))


def matrix_order(model) -> Column:
    """d of a Gaussian model vector of d means and d·d covariances."""
    return F.floor((F.sqrt(F.lit(1.0) + F.size(as_column(model)) * 4) - 1) / 2 + 1e-9).cast("int")


def model_mean(model, d: int | Column = 13) -> Column:
    return F.slice(as_column(model), 1, d)


def model_covariance(model, d: int = 13) -> Column:
    return F.slice(as_column(model), d + 1, d * d)


def diagonal(matrix, d: int) -> Column:
    matrix = as_column(matrix)
    return F.array(*[matrix[k * d + k] for k in range(d)])


def upper_triangle(matrix, d: int = 13) -> Column:
    """Row-major upper triangle with the diagonal: d·(d+1)/2 values."""
    matrix = as_column(matrix)
    return F.filter(matrix, lambda _, i: F.pmod(i, F.lit(d)) >= F.floor(i / d))


def euclidean_model_vector(model, d: int = 13) -> Column:
    """Means followed by the upper covariance triangle."""
    return F.concat(model_mean(model, d), upper_triangle(model_covariance(model, d), d))


def concat_features(types: str | Sequence[str]) -> Column:
    """Feature vectors side by side; accepts ``"rp+ssd"``, one name or a list."""
    names = types.split("+") if isinstance(types, str) else list(types)
    return F.col(names[0]) if len(names) == 1 else F.concat(*[F.col(name) for name in names])


def to_feature_frame(
    df: DataFrame, vec: str, dim: int, id_col: str | None = None, class_col: str | None = None, names=None
) -> DataFrame:
    """One named double column per dimension: ``feat0, feat1, …`` [, ID][, class]."""
    names = list(names) if names else [f"feat{i}" for i in range(dim)]
    if len(names) != dim:
        raise ValueError(f"{len(names)} names for {dim} dimensions")
    columns = [F.col(vec)[i].cast("double").alias(name) for i, name in enumerate(names)]
    if id_col:
        columns.append(F.col(id_col).cast("string").alias("ID"))
    if class_col:
        columns.append(F.col(class_col).cast("string").alias("class"))
    return df.select(*columns)
