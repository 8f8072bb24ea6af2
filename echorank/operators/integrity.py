"""Checks on ids."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

LISTED = 20  # ids named in an error message


def duplicate_ids(df: DataFrame) -> DataFrame:
    """``(id, count)`` of ids that occur more than once."""
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def check_duplicates(df: DataFrame, raise_error: bool = True) -> None:
    found = [row.id for row in duplicate_ids(df).orderBy("id").limit(LISTED).collect()]
    if found:
        message = f"duplicate ids: {'; '.join(map(str, found))}" + (" …" if len(found) == LISTED else "")
        if raise_error:
            raise ValueError(message)
        warnings.warn(message)


def dedupe(df: DataFrame) -> DataFrame:
    """Whole-row duplicates removed."""
    return df.dropDuplicates()


def _counts(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """How often every key occurs in every table: one shuffle of ids, counted first."""
    tagged = [t.select(*keys, F.lit(n).alias("_table")) for n, t in tables.items()]
    per_type = [F.count(F.when(F.col("_table") == n, 1)).alias(n) for n in tables]
    return reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(*per_type)


def id_consistency(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Ids that some type has more often than another, with the counts per type."""
    names = list(tables)
    unequal = reduce(lambda a, b: a | b, [F.col(names[0]) != F.col(n) for n in names[1:]], F.lit(False))
    return _counts(tables, ["id"]).where(unequal)


def order_consistency(tables: Mapping[str, DataFrame], position: str = "position") -> DataFrame:
    """As ``id_consistency``, for ids at their place in the file."""
    names = list(tables)
    unequal = reduce(lambda a, b: a | b, [F.col(names[0]) != F.col(n) for n in names[1:]], F.lit(False))
    return _counts(tables, [position, "id"]).where(unequal)


def check_id_consistency(tables: Mapping[str, DataFrame]) -> None:
    """Raise unless all types hold the same ids, equally often.

    The order does not count: for files see ``fileorder.check_file_order``, for tables
    with a position column ``order_consistency``.
    """
    if len(tables) < 2:
        return
    wrong = id_consistency(tables).orderBy("id").limit(LISTED).collect()
    if wrong:
        listed = "; ".join(f"{row.id} {[row[n] for n in tables]}" for row in wrong)
        raise ValueError(f"ids not matching across {list(tables)}: {listed}")


def row_count(df: DataFrame) -> int:
    return df.count()


def select_ids_ordered(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows of the given ids, in the given order; repeated ids repeat their row.

    The list is the caller's own, so it is small enough to be sent to every task
    if Spark finds it below its broadcast threshold; else it is shuffled.
    """
    wanted = df.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, _pos long")
    return df.join(wanted, "id").orderBy("_pos").drop("_pos")
