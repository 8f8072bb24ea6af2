"""Rank every item of a catalogue against one or many query items.

Two shapes of input:

* per-feature tables (``rank_full`` and the queries built on it): every distance
  is scaled over its own table, then items that have all features are ranked;
* one wide table (``rank_merged``): items are complete first, then scaled.

Both compute all distances in one pass over the vectors and write the slim
distance table once. Statistics, scaling and the sort read only that table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.filters import is_finite
from ..operators.ordering import rank_asc, rank_lexicographic
from ..operators.pairing import ALL_FEATURES, DISTANCES, distance_pairs, load_query_groups, sources_of
from ..operators.scaling import fuse_mean, minmax
from ..session import materialize

FAST = ("mfcc", "rh", "notes")
PRECISE = ("js", "rp", "chroma")
SCORE_ORDER = ("rp", "rh", "bh", "chroma", "notes", "mfcc", "skl", "js")
# Columns that travel with a source into the ranking.
LABELS = {"notes": ("key", "scale"), "bh": ("bpm",)}


def _labels(features: Sequence[str], columns: Sequence[str]) -> list[str]:
    used = sources_of(features)
    return [c for source, labels in LABELS.items() if source in used for c in labels if c in columns]


def _asked(songs: str | Sequence[str]) -> list[str]:
    songs = [songs] if isinstance(songs, str) else list(dict.fromkeys(songs))
    if not songs:
        raise ValueError("no query items")
    return songs


def _finish(scored: DataFrame, features: Sequence[str], labels: Sequence[str], single: bool) -> DataFrame:
    scores = [DISTANCES[f].scaled for f in features]
    columns = ["id", *labels, *scores]
    ranked = scored.select("query_id", *columns, fuse_mean(scores).alias("aggregated"))
    return rank_asc(ranked.drop("query_id")) if single else ranked


def _scale_columns(pairs: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale all distances per query; one row of bounds per query is joined back.

    The bounds have at most one row per query of the group, which is checked when
    the queries are loaded.
    """
    bounds = pairs.groupBy("query_id").agg(
        *[
            F.struct(F.min(DISTANCES[f].column).alias("low"), F.max(DISTANCES[f].column).alias("high")).alias(f"_{f}")
            for f in features
        ]
    )
    joined = pairs.join(F.broadcast(bounds), "query_id")
    return joined.withColumns(
        {
            DISTANCES[f].scaled: minmax(
                DISTANCES[f].column, F.col(f"_{f}.low"), F.col(f"_{f}.high"), DISTANCES[f].larger_is_closer
            )
            for f in features
        }
    )


def _complete(features: Sequence[str]) -> list[Column]:
    return [F.col(DISTANCES[f].column).isNotNull() & ~F.isnan(DISTANCES[f].column) for f in features]


def _present(feature: str) -> Column:
    """The distance is there and a number, and finite if the distance demands it."""
    distance = DISTANCES[feature]
    present = F.col(distance.column).isNotNull() & ~F.isnan(distance.column)
    return present & is_finite(distance.column) if distance.drops_infinite else present


def wide_distances(
    wide: DataFrame,
    songs: str | Sequence[str],
    features: Sequence[str] = ALL_FEATURES,
    unique_ids: bool = False,
    keep_infinite: bool = False,
    store: bool = True,
) -> DataFrame:
    """The distance table of a wide catalogue, written once.

    Copies of a row collapse before it is written, if any id repeats in the catalogue:
    that is looked up in its ids alone, unless they are known unique.
    Without ``store`` nothing is written and every use computes it again: that is
    cheaper where many queries want only their top-k of a very large catalogue.
    """
    labels = _labels(features, wide.columns)
    parts = []
    for queries in load_query_groups(wide, _asked(songs), sources_of(features)):
        pairs = distance_pairs(wide, queries, features, labels)
        checks = _complete(features) if keep_infinite else [_present(f) for f in features]
        parts.append(pairs.where(reduce(lambda a, b: a & b, checks)))
    pairs = reduce(DataFrame.unionByName, parts)
    repeated = not unique_ids and not wide.groupBy("id").count().where("count > 1").isEmpty()
    pairs = pairs.dropDuplicates() if repeated else pairs
    return materialize(pairs, "distances") if store else pairs


def _rank_wide(wide, songs, features, unique_ids, store, single) -> DataFrame:
    pairs = wide_distances(wide, songs, features, unique_ids, store=store)
    return _finish(_scale_columns(pairs, features), features, _labels(features, wide.columns), single)


def rank_merged(
    wide: DataFrame,
    song: str,
    features: Sequence[str] = ALL_FEATURES,
    unique_ids: bool = False,
    store: bool = True,
) -> DataFrame:
    """Rank a wide table: distances first, scaling over the complete rows."""
    return _rank_wide(wide, song, features, unique_ids, store, single=True)


def rank_batch(
    wide: DataFrame,
    songs: Sequence[str],
    features: Sequence[str] = ALL_FEATURES,
    unique_ids: bool = False,
    store: bool = True,
) -> DataFrame:
    """``rank_merged`` for many queries in one pass; rows carry ``query_id``.

    The rows are not sorted: use ``ordering.top_k(by=["query_id"])`` or
    ``with_position``.
    """
    return _rank_wide(wide, songs, features, unique_ids, store, single=False)


def table_distances(
    tables: Mapping[str, DataFrame], songs: str | Sequence[str], features: Sequence[str] = ALL_FEATURES
) -> DataFrame:
    """The distances of per-feature tables, written once.

    One row per query, item and source table; the columns of other sources are
    NULL. Distances that share a source share its scan and its Arrow batches.
    """
    parts = []
    for queries in load_query_groups(tables, _asked(songs), sources_of(features)):
        for source in sources_of(features):
            table = tables[source].where(F.col(source).isNotNull())
            wanted = [f for f in features if DISTANCES[f].source == source]
            labels = [c for c in LABELS.get(source, ()) if c in table.columns]
            parts.append(distance_pairs(table, queries, wanted, labels))
    return materialize(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "distances")


def _rank_tables(tables, songs, features, single) -> DataFrame:
    """Scale per table, then bring the scores of an item together.

    One shuffle on (query, item) replaces the chain of joins. The sets hold the
    distinct scores of an item: one each, unless an id occurs with different
    vectors, and then the ranking has every combination of them.
    """
    distances = table_distances(tables, songs, features)
    labels = _labels(features, distances.columns)
    clean = distances.withColumns(
        {DISTANCES[f].column: F.when(_present(f), F.col(DISTANCES[f].column)) for f in features}
    )
    scaled = _scale_columns(clean, features)
    sets = []
    for f in features:
        own = [c for c in LABELS.get(DISTANCES[f].source, ()) if c in labels]
        entry = F.when(F.col(DISTANCES[f].column).isNotNull(), F.struct(DISTANCES[f].scaled, *own))
        sets.append(F.collect_set(entry).alias(f"_{f}"))
    together = scaled.groupBy("query_id", "id").agg(*sets)
    together = together.where(reduce(lambda a, b: a & b, [F.size(f"_{f}") > 0 for f in features]))
    for f in features:
        together = together.withColumn(f"_{f}", F.explode(f"_{f}"))
    owner = {c: f for f in features for c in LABELS.get(DISTANCES[f].source, ()) if c in labels}
    complete = together.select(
        "query_id",
        "id",
        *[F.col(f"_{owner[c]}.{c}").alias(c) for c in labels],
        *[F.col(f"_{f}.{DISTANCES[f].scaled}") for f in features],
    )
    return _finish(complete, features, labels, single)


def rank_full(tables: Mapping[str, DataFrame], song: str, features: Sequence[str] = ALL_FEATURES) -> DataFrame:
    """Rank per-feature tables ``{source: (id, source[, labels])}``.

    Sources are ``rp rh bh notes chroma mfcc``. Every distance is scaled over
    its own table, before items without all features vanish.
    """
    return _rank_tables(tables, song, features, single=True)


def rank_fast(tables: Mapping[str, DataFrame], song: str) -> DataFrame:
    """Timbre vector, rhythm histogram and notes."""
    return rank_full(tables, song, FAST)


def rank_precise(tables: Mapping[str, DataFrame], song: str) -> DataFrame:
    """Jensen-Shannon timbre, rhythm pattern and chroma."""
    return rank_full(tables, song, PRECISE)


def rank_full_batch(
    tables: Mapping[str, DataFrame], songs: Sequence[str], features: Sequence[str] = ALL_FEATURES
) -> DataFrame:
    """``rank_full`` for many queries in one pass, unsorted, with ``query_id``."""
    return _rank_tables(tables, songs, features, single=False)


def rank_scores(
    tables: Mapping[str, DataFrame], song: str, features: Sequence[str] = SCORE_ORDER, lexicographic: bool = False
) -> DataFrame:
    """``(id, scores, mean)``: all scores of an item as one list."""
    ranked = _rank_tables(tables, song, features, single=False)
    scores = ranked.select(
        "id",
        F.array(*[F.col(DISTANCES[f].scaled) for f in features]).alias("scores"),
        F.col("aggregated").alias("mean"),
    )
    return rank_lexicographic(scores) if lexicographic else rank_asc(scores, "mean")
