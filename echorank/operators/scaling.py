"""Statistics, min-max scaling and fusion of distance columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import as_column


def global_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """min, max, mean and sample standard deviation of all columns in one pass."""
    stats = []
    for c in columns:
        stats += [
            F.min(c).alias(f"min_{c}"),
            F.max(c).alias(f"max_{c}"),
            F.avg(c).alias(f"mean_{c}"),
            F.stddev_samp(c).alias(f"stddev_{c}"),
        ]
    return df.groupBy(*by).agg(*stats)


def minmax(value, low, high, inverted: bool = False) -> Column:
    """``(value-low)/(high-low)``; NULL when all values are equal."""
    value, low, high = map(as_column, (value, low, high))
    scaled = F.try_divide(value - low, high - low)
    return F.lit(1.0) - scaled if inverted else scaled


def minmax_scale(df: DataFrame, column: str, alias: str, inverted: bool = False) -> DataFrame:
    """Scale one column over its table; the bounds are one scalar subquery."""
    bounds = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("b")).scalar()
    with_bounds = df.withColumn("_bounds", bounds)
    scaled = minmax(column, F.col("_bounds.low"), F.col("_bounds.high"), inverted)
    return with_bounds.withColumn(alias, scaled).drop("_bounds")


def fuse_mean(scores: Sequence[str]) -> Column:
    """Unweighted mean of the scores; NULL if one of them is."""
    return reduce(lambda a, b: a + b, [F.col(s) for s in scores]) / len(scores)
