"""Seven statistics per group, and element-wise statistics of vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.arrow import matrix_of
from ..functions.rhythm import row_moments
from ..session import materialize
from .medians import BROADCAST_KEYS, SMALL_GROUP, grouped_median

# The statistics and their order in a flattened vector.
MOMENTS = ("mean", "var", "skew", "kurtosis", "median", "min", "max")

# A deviation below this share of the mean is rounding.
RESOLUTION = 1e-15


def _or_zero(value: Column) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def moments7(df: DataFrame, keys: Sequence[str], value: str, small_group: int = SMALL_GROUP) -> DataFrame:
    """mean, population variance, skewness, Pearson kurtosis, median, min, max.

    Undefined ones are 0. A group that is constant up to rounding has variance,
    skewness and kurtosis 0. Everything but the median merges partial results, so a
    hot group is one row per partition in the shuffle.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    stats = df.groupBy(*keys).agg(
        _or_zero(F.avg(x)).alias("mean"),
        _or_zero(F.var_pop(x)).alias("var"),
        _or_zero(F.skewness(x)).alias("skew"),
        _or_zero(F.kurtosis(x) + 3).alias("kurtosis"),
        _or_zero(F.min(x)).alias("min"),
        _or_zero(F.max(x)).alias("max"),
    )
    flat = F.col("var") <= F.pow(F.lit(RESOLUTION) * F.col("mean"), F.lit(2.0))
    spread = {m: F.when(flat, F.lit(0.0)).otherwise(F.col(m)) for m in ("skew", "kurtosis", "var")}
    stats = stats.withColumns(spread)
    medians = grouped_median(df, keys, value, small_group=small_group)
    return stats.join(medians, keys, "left").select(*keys, *[F.coalesce(m, F.lit(0.0)).alias(m) for m in MOMENTS])


# Values of a group that one task takes together as a matrix (32 MB).
GROUP_VALUES = 1 << 22


def _positions(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("pos", "x"))


def _vector(values: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Positions back into one vector; its length is that of the feature."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return values.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def _by_matrix(
    df: DataFrame,
    keys: Sequence[str],
    vec: str,
    name: str,
    statistic: Callable[[np.ndarray], np.ndarray],
    by_position: Callable[[DataFrame], DataFrame],
    group_values: int,
) -> DataFrame:
    """``statistic`` of each group's matrix, one row a vector; vectors move whole, once.

    Groups are measured first, partially on the map side. One that is larger than
    ``group_values``, or has vectors of several lengths, missing values or values that
    are not numbers, takes the way of its single positions, which merges partial
    results and holds no group; the keys of those are written, and broadcast if few.
    """
    keys = list(keys)
    rows = df.where(F.size(vec) > 0).select(*keys, F.col(vec).cast("array<double>").alias("_v"))
    gap = F.exists("_v", lambda x: x.isNull() | F.isnan(x))
    sizes = rows.groupBy(*keys).agg(
        F.sum(F.size("_v").cast("long")).alias("_n"), F.min(F.size("_v")).alias("_low"), F.max(F.size("_v")).alias("_high"), F.max(gap).alias("_gap")
    )
    single = (F.col("_n") > group_values) | (F.col("_low") < F.col("_high")) | F.col("_gap")
    renamed = [F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]
    apart = materialize(sizes.where(single).select(*renamed), "groups-by-position")
    found = apart.count()

    def whole(group: pa.Table) -> pa.Table:
        _, matrix = matrix_of(group["_v"].combine_chunks())
        first = [group[k].slice(0, 1).combine_chunks() for k in keys]
        return pa.Table.from_arrays([*first, pa.array([statistic(matrix)], pa.list_(pa.float64()))], [*keys, name])

    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    if found == 0:
        return rows.groupBy(*keys).applyInArrow(whole, schema)
    apart = F.broadcast(apart) if found <= BROADCAST_KEYS else apart
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    together = rows.join(apart, same, "left_anti").groupBy(*keys).applyInArrow(whole, schema)
    return together.unionByName(by_position(rows.join(apart, same, "left_semi")))


def segment_mean(df: DataFrame, keys: Sequence[str], vec: str, name: str | None = None, group_values: int = GROUP_VALUES) -> DataFrame:
    """Element-wise mean of the vectors of a group."""
    name = name or vec

    def by_position(rows: DataFrame) -> DataFrame:
        means = _positions(rows, keys, "_v").groupBy(*keys, "pos").agg(F.avg("x").alias("m"))
        return _vector(means, keys, "m", name)

    return _by_matrix(df, keys, vec, name, lambda m: m.mean(axis=0), by_position, group_values)


def segment_median(
    df: DataFrame,
    keys: Sequence[str],
    vec: str,
    name: str | None = None,
    small_group: int = SMALL_GROUP,
    group_values: int = GROUP_VALUES,
) -> DataFrame:
    """Element-wise median of the vectors of a group."""
    name = name or vec

    def by_position(rows: DataFrame) -> DataFrame:
        return _vector(grouped_median(_positions(rows, keys, "_v"), [*keys, "pos"], "x", "m", small_group), keys, "m", name)

    return _by_matrix(df, keys, vec, name, lambda m: np.median(m, axis=0), by_position, group_values)


def segment_stats(
    df: DataFrame,
    keys: Sequence[str],
    vec: str,
    name: str | None = None,
    small_group: int = SMALL_GROUP,
    group_values: int = GROUP_VALUES,
) -> DataFrame:
    """The seven statistics over the vectors of a group, statistic-major: 7·dim values."""
    name = name or vec

    def by_position(rows: DataFrame) -> DataFrame:
        stats = moments7(_positions(rows, keys, "_v"), [*keys, "pos"], "x", small_group)
        pairs = F.array_sort(F.collect_list(F.struct("pos", *MOMENTS)))
        parts = [F.col("_s")[m] for m in MOMENTS]
        return stats.groupBy(*keys).agg(pairs.alias("_s")).select(*keys, F.concat(*parts).alias(name))

    return _by_matrix(df, keys, vec, name, lambda m: row_moments(m.T).ravel(order="F"), by_position, group_values)
