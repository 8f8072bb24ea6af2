"""Row filters of the rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import as_column, normalize_id_text


def valid_chroma(payload) -> Column:
    """A chroma payload whose first number is between 0 and 2; ``[]`` is none."""
    return as_column(payload).rlike(r"^\[\[[01]\.")


def by_id(df: DataFrame, item: str) -> DataFrame:
    """The rows of one item, pushed down to the scan."""
    return df.where(F.col("id") == normalize_id_text(item))


def is_finite(value) -> Column:
    value = as_column(value)
    return ~F.isnan(value) & (value != float("inf"))


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows whose distance is infinite or NaN (which would poison a maximum)."""
    return df.where(reduce(lambda a, b: a & b, [is_finite(c) for c in columns])) if columns else df


def below_mean(df: DataFrame, column: str) -> DataFrame:
    """Rows strictly below the mean of the column; one scalar subquery."""
    return df.where(F.col(column) < df.agg(F.avg(column)).scalar())


def above_mean(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) > df.agg(F.avg(column)).scalar())
