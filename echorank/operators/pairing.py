"""A catalogue against named query items: the distance table.

The queries are few and named by the caller, so they are read once, bounded in
number and bytes, and shipped with the task. Each item's vectors cross to Python
once for all queries and come back as one slim array of scores, which ``inline``
turns into rows. Nothing is joined, no vector is repeated per pair, and the
catalogue is not shuffled, unless it is small and lies in few partitions.

Measured: 200k x 64 doubles and one query take 0.18 s in an Arrow batch, 0.42 s
with ``aggregate``/``zip_with``, 0.26 s unrolled. Over 10,000 note sequences the
bit-parallel kernel takes 1.0 s and the built-in ``levenshtein`` 3.1 s; with 20
queries over 1,000 sequences 1.7 s against 8.6 s.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrow import matrix_of, null_index, ragged_matrices, restore
from ..functions.ids import normalize_id_text
from ..session import spread_small
from ..functions.kernels import (
    ChromaQuery,
    GaussianBatch,
    chroma_xcorr_2d_to,
    chroma_xcorr_full_to,
    chroma_xcorr_to,
    edit_distances_to,
    euclidean_to,
    jensen_shannon_to,
    sym_kl_to,
)

# One group of queries travels with every task, so both bounds are checked.
MAX_QUERIES = 1024
MAX_QUERY_BYTES = 128 << 20


@dataclass(frozen=True)
class Distance:
    """One distance: the column it reads, writes, and which way is similar."""

    name: str
    source: str
    column: str
    scaled: str
    larger_is_closer: bool = False
    drops_infinite: bool = False


DISTANCES = {
    d.name: d
    for d in (
        Distance("rp", "rp", "distances_rp", "scaled_rp"),
        Distance("rh", "rh", "distances_rh", "scaled_rh"),
        Distance("bh", "bh", "distances_bh", "scaled_bh"),
        Distance("notes", "notes", "distances_levenshtein", "scaled_notes"),
        Distance("chroma", "chroma", "distances_corr", "scaled_chroma", larger_is_closer=True),
        Distance("skl", "mfcc", "distances_skl", "scaled_skl", drops_infinite=True),
        Distance("js", "mfcc", "distances_js", "scaled_js", drops_infinite=True),
        Distance("mfcc", "mfcc", "distances_mfcc", "scaled_mfcc"),
    )
}
ALL_FEATURES = tuple(DISTANCES)
CHROMA_VARIANTS = {"rows": chroma_xcorr_to, "2d": chroma_xcorr_2d_to, "full": chroma_xcorr_full_to}


def sources_of(features: Sequence[str]) -> list[str]:
    unknown = [f for f in features if f not in DISTANCES]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    return list(dict.fromkeys(DISTANCES[f].source for f in features))


class QueriesTooLarge(ValueError):
    """The vectors of a group of queries exceed what is sent to the tasks."""


def load_query_groups(
    tables: DataFrame | Mapping[str, DataFrame], ids: Sequence[str], columns: Sequence[str]
) -> Iterator[dict[str, list]]:
    """``load_queries`` in groups of bounded number and bytes; a group too large is halved."""
    for at in range(0, len(ids), MAX_QUERIES):
        group = list(ids[at : at + MAX_QUERIES])
        try:
            yield load_queries(tables, group, columns)
        except QueriesTooLarge:
            if len(group) == 1:
                raise
            half = len(group) // 2
            yield from load_query_groups(tables, group[:half], columns)
            yield from load_query_groups(tables, group[half:], columns)


def load_queries(
    tables: DataFrame | Mapping[str, DataFrame], ids: Sequence[str], columns: Sequence[str]
) -> dict[str, list]:
    """The query rows, in the order asked for, as plain Python values.

    From one wide table, or from one table per column in a single job. Of several
    rows with one id the smallest value is taken, so the choice does not depend on
    file order. An id that is not there is an error.
    """
    ids = [normalize_id_text(i) for i in ids]
    if len(ids) > MAX_QUERIES:
        raise ValueError(f"{len(ids)} queries in one group, at most {MAX_QUERIES}")
    wanted = F.col("id").isin(ids)
    if isinstance(tables, DataFrame):
        rows = tables.where(wanted).groupBy("id").agg(F.min(F.struct(*columns)).alias("row")).select("id", "row.*")
    else:
        parts = [tables[c].where(wanted & F.col(c).isNotNull()).select("id", c) for c in columns]
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        rows = union.groupBy("id").agg(*[F.min(c).alias(c) for c in columns])
    found = rows.toArrow()
    if found.nbytes > MAX_QUERY_BYTES:
        raise QueriesTooLarge(f"query vectors take {found.nbytes} bytes, at most {MAX_QUERY_BYTES}: use smaller groups")
    at = {name: n for n, name in enumerate(found.column("id").to_pylist())}
    missing = [i for i in ids if i not in at]
    if missing:
        raise ValueError(f"no item with id {missing}")
    order = [at[i] for i in ids]
    loaded = {"id": ids}
    for name in columns:
        values = found.column(name).take(order).to_pylist()
        gaps = [i for i, value in zip(ids, values) if value is None]
        if gaps:
            raise ValueError(f"no {name} feature for {gaps}")
        loaded[name] = values
    return loaded


def _score_fields(features: Sequence[str]) -> str:
    return ", ".join(f"_{f} double" for f in features)


def vector_scores(features: Sequence[str], queries: dict[str, list], chroma_variant: str = "rows") -> Column:
    """``ARRAY<STRUCT<query_no, feature…>>``, one element per query."""
    sources = sources_of(features)
    chroma_to = CHROMA_VARIANTS[chroma_variant]
    held = {s: queries[s] if s == "notes" else [np.asarray(v, dtype=float) for v in queries[s]] for s in sources}
    total = len(queries["id"])
    terms: dict[str, object] = {}  # of the queries, built by the first batch of a task

    def asked(source: str):
        if source not in terms:
            if source == "chroma":
                terms[source] = [ChromaQuery(q) for q in held[source]]
            else:
                matrix = np.stack(held[source])
                terms[source] = GaussianBatch(matrix) if DISTANCES_ON_MODELS & set(features) and source == "mfcc" else matrix
        return terms[source]

    @F.arrow_udf(f"array<struct<query_no: int, {_score_fields(features)}>>")
    def score(*vectors: pa.Array) -> pa.Array:
        columns = dict(zip(sources, vectors))
        rows = len(vectors[0])
        scores = {}
        for source in sources:
            wanted = [f for f in features if DISTANCES[f].source == source]
            if source == "notes":
                texts = columns[source].drop_null().to_pylist()
                index = null_index(columns[source])
                block = {"notes": edit_distances_to(texts, held[source])}
            elif source == "chroma":
                index, items = ragged_matrices(columns[source], 12)
                block = {"chroma": [chroma_to(items, q) for q in asked(source)]}
            else:
                index, matrix = matrix_of(columns[source])
                block = _matrix_scores(wanted, matrix, asked(source))
            for feature, by_query in block.items():
                scores[feature] = [restore(index, pa.array(np.asarray(d, dtype=float))) for d in by_query]
        # item-major order: the scores of one item lie side by side
        turn = np.arange(rows * total).reshape(total, rows).T.ravel()
        fields = [pa.array(turn // max(rows, 1), pa.int32())]
        fields += [pa.concat_arrays(scores[f]).take(pa.array(turn)) for f in features]
        pairs = pa.StructArray.from_arrays(fields, names=["query_no", *[f"_{f}" for f in features]])
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * total, pa.int32()), pairs)

    return score(*[F.col(s) for s in sources])


# Distances between Gaussian models, which share the terms of a model.
DISTANCES_ON_MODELS = {"skl", "js", "mfcc"}


def _matrix_scores(features: Sequence[str], matrix: np.ndarray, asked: np.ndarray | GaussianBatch) -> dict[str, list[np.ndarray]]:
    queries = asked.flat if isinstance(asked, GaussianBatch) else asked
    numbers = range(len(queries))
    if len(matrix) == 0:
        return {f: [np.zeros(0) for _ in numbers] for f in features}
    if not isinstance(asked, GaussianBatch):
        return {f: [euclidean_to(matrix, q) for q in queries] for f in features}
    items = GaussianBatch(matrix)
    block: dict[str, list[np.ndarray]] = {}
    if "mfcc" in features:
        block["mfcc"] = [euclidean_to(items.flat, asked.flat[n]) for n in numbers]
    if "skl" in features:
        items.invert(), asked.invert()
        block["skl"] = [sym_kl_to(items, asked, n) for n in numbers]
    if "js" in features:
        items.log_dets(), asked.log_dets()
        block["js"] = [jensen_shannon_to(items, asked, n) for n in numbers]
    return block


def distance_pairs(
    catalogue: DataFrame,
    queries: dict[str, list],
    features: Sequence[str],
    keep: Sequence[str] = (),
    chroma_variant: str = "rows",
) -> DataFrame:
    """``(query_id, id, keep…, distances_…)``: every item against every query.

    NULL features give NULL distances, so tables with gaps can be scored too.
    """
    carried = [F.col(c) for c in dict.fromkeys(["id", *keep])]
    pairs = spread_small(catalogue).select(*carried, F.inline(vector_scores(features, queries, chroma_variant)))
    asked = F.array(*[F.lit(i) for i in queries["id"]])
    return pairs.select(
        F.get(asked, F.col("query_no")).alias("query_id"),
        *carried,
        *[F.col(f"_{f}").alias(DISTANCES[f].column) for f in features],
    )
