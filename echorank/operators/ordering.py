"""Ranking order, top-k and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

# Up to this k Spark cuts each partition to its k best rows before the shuffle.
GROUP_LIMIT = 1000


def rank_order(score: str = "aggregated") -> list[Column]:
    return [F.col(score).asc_nulls_last(), F.col("id").asc()]


def rank_asc(df: DataFrame, score: str = "aggregated") -> DataFrame:
    """Ascending score, ties by id, missing scores last.

    The id is part of the sort key, so a large group of equal scores is split
    between range partitions.
    """
    return df.orderBy(*rank_order(score))


def rank_lexicographic(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Order by the list of scores, first entry first."""
    return df.orderBy(F.col(scores).asc(), F.col("id").asc())


def top_k(df: DataFrame, k: int, score: str = "aggregated", by: Sequence[str] = ()) -> DataFrame:
    """The k best rows, or the k best per group.

    Without groups this is one bounded heap per partition. With groups Spark
    prefilters each partition to k rows per group; above its limit for that,
    a group is first cut in salted slices so that no task sees all its rows.
    """
    if not by:
        return rank_asc(df, score).limit(k)
    if k > GROUP_LIMIT:
        slices = df.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(256)))
        df = _first_k(slices, [*by, "_slice"], k, score).drop("_slice")
    return _first_k(df, by, k, score)


def _first_k(df: DataFrame, by: Sequence[str], k: int, score: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*rank_order(score))
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k).drop("_n")


def with_position(df: DataFrame, score: str = "aggregated", by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Add the 0-based position in the ranking, per group if asked.

    A window over a whole ranking would put it in one task. Here rows are range
    partitioned and sorted by group, score and id, numbered inside their
    partition, and shifted by the sizes of the partitions before: one row per
    partition. The numbered rows are written once, since a range partitioning
    need not come out the same twice.
    """
    order = [*[F.col(c) for c in by], *rank_order(score)]
    # monotonically_increasing_id: partition above bit 33, row number below
    numbered = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "positions",
    ).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        numbered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    placed = numbered.join(starts, "_part").withColumn(
        name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    if by:
        first = placed.groupBy(*by).agg(F.min(name).alias("_first"))
        placed = placed.join(first, list(by)).withColumn(name, F.col(name) - F.col("_first")).drop("_first")
    return placed.drop("_at", "_part", "_start")
