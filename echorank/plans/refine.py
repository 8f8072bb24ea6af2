"""Filter-and-refine: after every distance only the better-than-mean rows stay."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.filters import is_finite
from ..operators.pairing import DISTANCES, distance_pairs, load_queries, sources_of
from ..operators.scaling import minmax
from ..session import materialize
from .ranking import _finish, _labels, wide_distances

CHROMA_FIRST = ("chroma", "js", "skl", "mfcc", "rp", "rh", "bh", "notes")
BH_FIRST = ("bh", "rh", "notes", "rp", "js", "skl", "mfcc", "chroma")

# Distances worth a stage of their own: edit distance and cross-correlation.
COSTLY = {"notes", "chroma"}


def rank_filter_refine(
    wide: DataFrame,
    song: str | Sequence[str],
    order: Sequence[str] = CHROMA_FIRST,
    unique_ids: bool = False,
) -> DataFrame:
    """Rank the rows that beat the mean in every step of ``order``.

    Each step takes min, max and mean over the current survivors, drops rows not
    strictly better than the mean and scales with the bounds before the drop.

    One query runs in stages: a costly distance (``COSTLY``) is computed only for the
    rows that have survived the steps before it. A stage writes the distances of its
    steps together with the vectors that later stages need; steps about halve the
    rows, so all stages write little more than the first. Cheap distances share a
    stage, since a pass over survivors reads the same Parquet pages as one over all
    rows. Several queries, or ids that repeat, take all distances in one pass.

    A step brings one row of three numbers per query to the driver, which keeps the
    plan flat: nested subqueries would double it eight times. With one query these
    numbers are literals, so the filters of all steps so far reach the scan.

    An infinite distance is dropped at its own step, so it still counts in the
    statistics of the steps before; so is one that is not a number, in a later stage.
    """
    single = isinstance(song, str)
    labels = _labels(order, wide.columns)
    if not single or (not unique_ids and not wide.groupBy("id").count().where("count > 1").isEmpty()):
        survivors = wide_distances(wide, song, order, unique_ids, keep_infinite=True)
        return _finish(_steps(survivors, order, single), order, labels, single)
    queries = load_queries(wide, [song], sources_of(order))
    survivors = wide.where(reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in sources_of(order)]))
    scores: list[str] = []
    for n, (group, later) in enumerate(_stages(order)):
        rows = survivors.select("id", *labels, *scores, *sources_of([*group, *later]))
        pairs = distance_pairs(rows, queries, group, [*labels, *scores, *sources_of(later)])
        complete = [F.col(DISTANCES[f].column).isNotNull() & ~F.isnan(DISTANCES[f].column) for f in group]
        stage = materialize(pairs.where(reduce(lambda a, b: a & b, complete)), f"refine-{n}")
        survivors = _steps(stage, group, single)
        scores += [DISTANCES[f].scaled for f in group]
    return _finish(survivors, order, labels, single)


def _stages(order: Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """Steps computed together, and the steps after them: a costly one begins a stage."""
    cuts = [n for n, f in enumerate(order) if n and f in COSTLY]
    bounds = [0, *cuts, len(order)]
    return [(list(order[a:b]), list(order[b:])) for a, b in zip(bounds, bounds[1:])]


def _steps(survivors: DataFrame, order: Sequence[str], single: bool) -> DataFrame:
    """The steps over a written distance table."""
    for feature in order:
        distance = DISTANCES[feature]
        column = F.col(distance.column)
        if distance.drops_infinite:
            survivors = survivors.where(is_finite(column))
        stats = (
            survivors.groupBy("query_id")
            .agg(F.min(column).alias("_low"), F.max(column).alias("_high"), F.avg(column).alias("_mean"))
            .toPandas()
        )
        survivors = _with_stats(survivors, stats, single)
        better = column > F.col("_mean") if distance.larger_is_closer else column < F.col("_mean")
        scaled = minmax(column, F.col("_low"), F.col("_high"), distance.larger_is_closer)
        survivors = survivors.where(better).withColumn(distance.scaled, scaled).drop("_low", "_high", "_mean")
    return survivors


def _with_stats(survivors: DataFrame, stats: pd.DataFrame, single: bool) -> DataFrame:
    """The statistics of a step as columns: at most one row per query."""
    if single:
        row = stats.iloc[0] if len(stats) else {}
        names = ("_low", "_high", "_mean")
        return survivors.withColumns({n: F.lit(float(row[n]) if len(row) else None).cast("double") for n in names})
    schema = "query_id string, _low double, _high double, _mean double"
    return survivors.join(F.broadcast(survivors.sparkSession.createDataFrame(stats, schema)), "query_id")
