"""Exact medians per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

# The built-in median keeps all values of a group in one task. Up to here it may.
SMALL_GROUP = 1_000_000
# Rank error of the sketch that brackets the median of a larger group.
SKETCH_ACCURACY = 10_000
# Keys of large groups that may be broadcast.
BROADCAST_KEYS = 100_000


def grouped_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", small_group: int = SMALL_GROUP
) -> DataFrame:
    """``(keys…, name)``: the median of the non-NULL values of each group.

    Groups are counted first, partially on the map side, and the large ones, of
    which there are at most rows / small_group, are stored. Usually there are none
    and the built-in aggregate does it all. For large ones a mergeable sketch
    gives two values that enclose the median; the values between them, a few per
    mille, are counted by value and the middle one is picked by rank. That is
    exact, copies of one value collapse before the shuffle, and no task holds a
    large group. The few keys are broadcast; if they are many, Spark joins them
    as it sees fit.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(sizes.where(F.col("_n") > small_group), "large-groups")
    found = large.count()
    if found == 0:
        return rows.groupBy(*keys).agg(F.median("_v").alias(name))
    if found <= BROADCAST_KEYS:
        large = F.broadcast(large)
    small = rows.join(large, keys, "left_anti").groupBy(*keys).agg(F.median("_v").alias(name))
    return small.unionByName(_large_median(rows.join(large, keys), keys, name, found <= BROADCAST_KEYS))


def _large_median(rows: DataFrame, keys: list[str], name: str, few: bool) -> DataFrame:
    margin = 20 / SKETCH_ACCURACY
    bounds = F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], SKETCH_ACCURACY)
    brackets = rows.groupBy(*keys).agg(bounds.alias("_b")).select(*keys, F.get("_b", F.lit(0)).alias("_lo"), F.get("_b", F.lit(1)).alias("_hi"))
    brackets = F.broadcast(brackets) if few else brackets
    # One row per distinct value inside the bracket, one for everything below it.
    placed = rows.join(brackets, keys).where(F.col("_v") <= F.col("_hi"))
    below = F.col("_v") < F.col("_lo")
    counted = (
        placed.groupBy(*keys, "_n", F.when(~below, F.col("_v")).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*keys).orderBy(F.col("_x").asc_nulls_first())
    ranked = counted.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    low_rank, high_rank = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)

    def at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_x")))

    picked = ranked.groupBy(*keys).agg(((at(low_rank) + at(high_rank)) / 2).alias(name))
    missed = F.raise_error(F.lit("the sketch did not enclose the median")).cast("double")
    return picked.withColumn(name, F.coalesce(name, missed))
