"""Joins between feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def assemble_features(tables: Sequence[DataFrame], how: str = "inner", dedupe: bool | None = None) -> DataFrame:
    """One wide table by id; items lacking a feature vanish with ``inner``.

    Whole-row copies are removed before the join, where they would multiply; the
    distinct result is the same. That shuffles the vectors once more, so by
    default only tables in which an id repeats are deduplicated: the check reads
    nothing but ids. Write the result to Parquet: every ranking then reads only
    the columns it scores.
    """

    def repeats(table: DataFrame) -> bool:
        return not table.groupBy("id").count().where("count > 1").isEmpty()

    distinct = [t.dropDuplicates() if dedupe or (dedupe is None and repeats(t)) else t for t in tables]
    return reduce(lambda a, b: a.join(b, "id", how), distinct)


def fuse_join(tables: Sequence[DataFrame], on: Sequence[str] = ("id",)) -> DataFrame:
    """Inner join of score tables by id, whole-row duplicates removed.

    A table is dealt out by id once: equal rows meet there, and so do the tables.
    """
    return reduce(lambda a, b: a.join(b, list(on), "inner"), [t.repartition(*on).dropDuplicates() for t in tables])


def anti_existing(new: DataFrame, existing: DataFrame, on: str = "id") -> DataFrame:
    """Rows of ``new`` whose id is not in ``existing``; reads only that column."""
    return new.join(existing.select(on), on, "left_anti")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    key: str,
    at: str,
    start: str,
    end: str,
    width: int,
) -> DataFrame:
    """Points of a key with the half-open ``[start, end)`` they fall in.

    An equality on ``(key, slice)`` with slices of ``width``, then the exact
    condition: a hot key is spread over its slices. Intervals of one key that do
    not overlap take at most one row each plus one per slice they span.
    """
    slices = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    spread = intervals.where(F.col(start) < F.col(end)).withColumn("_slice", F.explode(slices))
    sliced = points.withColumn("_slice", F.floor(F.col(at) / width))
    return (
        sliced.join(spread, [key, "_slice"])
        .where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
        .drop("_slice")
    )


def previous_value(df: DataFrame, key: str, order: str, width: float, name: str = "prev") -> DataFrame:
    """``(key, order, n, prev)``: distinct values, how often they occur, and the
    next smaller value of the same key, NULL for the first.

    Copies are counted before anything else. ``lag`` runs inside slices of
    ``width``; the first row of a slice takes the last value of the slice before,
    found among one row per key and slice. So neither a hot key nor a hot value
    has its rows in one task; ``width`` should span thousands of values.
    """
    values = df.groupBy(key, order).agg(F.count(F.lit(1)).alias("n"))
    sliced = values.withColumn("_slice", F.floor(F.col(order) / width))
    inside = F.lag(order).over(Window.partitionBy(key, "_slice").orderBy(order))
    before = F.lag("_last").over(Window.partitionBy(key).orderBy("_slice"))
    tails = (
        sliced.groupBy(key, "_slice")
        .agg(F.max(order).alias("_last"))
        .select(key, "_slice", before.alias("_before"))
    )
    return (
        sliced.withColumn("_inside", inside)
        .join(tails, [key, "_slice"])
        .withColumn(name, F.coalesce("_inside", "_before"))
        .drop("_slice", "_inside", "_before")
    )
