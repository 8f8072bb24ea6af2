"""Top-k of many queries from every item's place among a few pivots.

Distances to pivots fix an item's place in the space that the pivots span, and its height
above it. These few numbers are computed once and stored beside the vectors. With places u
and v and heights g and h of a query and an item,

    |u - v|^2 + (g - h)^2  <=  d(q,x)^2  <=  |u - v|^2 + (g + h)^2,

the triangle inequality applied to the heights, which is at least as narrow as the one on
the distances to single pivots. Scaling needs the exact least and largest distance of each
feature, the ranking the k best means; both are found in two steps, bounds for all items
from the slim columns and exact distances only for items that the bounds leave open. No
table of queries times items is ever written.

Features are those whose distance is Euclidean: rp, rh, bh and mfcc (the timbre vector).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrow import matrix_of
from ..functions.kernels import GaussianBatch
from ..operators.ordering import top_k
from ..operators.pairing import DISTANCES, load_query_groups, sources_of
from ..session import materialize
from .ranking import rank_batch

METRIC = ("rp", "rh", "bh", "mfcc")
# Pivots of a feature, and rows of the sample they are chosen from: only speed depends on them.
PIVOTS, SAMPLE = 16, 2000
# Items per query and feature whose distances are computed before the others are judged.
SEEDS = 8
# Bounds are widened by this share of the numbers they come from: a height is a root of a
# difference, so it keeps half of a double's digits.
SLACK = 1e-7


@dataclass
class PivotIndex:
    """Items with their vectors and places (``_p_<feature>``: coordinates, then the height).

    The space of a feature is a point of origin and orthonormal directions, one a row.
    """

    table: DataFrame
    pivots: dict[str, np.ndarray]

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.pivots)


@dataclass
class Verified:
    """Pairs of queries and items, and how many of them had exact distances computed."""

    pairs: int
    for_scaling: int
    for_ranking: int


def _points(feature: str, vectors: pa.Array) -> np.ndarray:
    matrix = matrix_of(vectors)[1]
    return GaussianBatch(matrix).flat if feature == "mfcc" and len(matrix) else matrix


def _span(points: np.ndarray, n: int) -> np.ndarray:
    """Origin and orthonormal directions of the space of pivots that lie far from each other.

    Each pivot is the point farthest from the space of those before it.
    """
    origin = points[int(np.argmax(np.linalg.norm(points - points.mean(axis=0), axis=1)))]
    rest, out = points - origin, [origin]
    while len(out) <= min(n, points.shape[1]):
        height = np.linalg.norm(rest, axis=1)
        top = int(np.argmax(height))
        if height[top] <= 1e-6 * (1e-300 + np.abs(points).max()):
            break
        out.append(rest[top] / height[top])
        rest = rest - np.outer(rest @ out[-1], out[-1])
    return np.stack(out)


def _places(points: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Coordinates in the space and the height above it, one row a point."""
    rest = points - space[0]
    at = rest @ space[1:].T
    height = np.sqrt(np.maximum(np.einsum("ij,ij->i", rest, rest) - np.einsum("ij,ij->i", at, at), 0))
    return np.column_stack([at, height])


def build_index(wide: DataFrame, features: Sequence[str] = METRIC, pivots: int = PIVOTS, sample: int = SAMPLE) -> PivotIndex:
    """The index of a wide catalogue, written once to the shared folder.

    Rows that lack a feature, or hold NaN or infinite numbers, are left out: they have no
    complete distances. An id may occur with several vectors; copies of a row are one.
    """
    if not set(features) <= set(METRIC):
        raise ValueError(f"no metric: {sorted(set(features) - set(METRIC))}")
    whole = [F.coalesce(F.forall(DISTANCES[f].source, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) for f in features]
    rows = wide.where("id IS NOT NULL")
    for condition in whole:
        rows = rows.where(condition)
    rows = rows.select("id", *sources_of(features))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates()
    some = rows.orderBy(F.xxhash64("id"), *rows.columns).limit(sample).toArrow().combine_chunks()
    if not some.num_rows:
        return PivotIndex(materialize(rows.withColumns({f"_p_{f}": F.array().cast("array<double>") for f in features}), "pivots"), {f: np.zeros((0, 0)) for f in features})
    chosen = {f: _span(_points(f, some[DISTANCES[f].source].combine_chunks()), pivots) for f in features}

    def stored(f: str):
        @F.arrow_udf("array<double>")
        def place(vectors: pa.Array) -> pa.Array:
            places = _places(_points(f, vectors), chosen[f]).ravel() if len(vectors) else np.zeros(0)
            return pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * len(chosen[f]), pa.array(places))

        return place(F.col(DISTANCES[f].source))

    return PivotIndex(materialize(rows.withColumns({f"_p_{f}": stored(f) for f in features}), "pivots"), chosen)


def save_index(index: PivotIndex, path: str) -> None:
    """The index below ``path``: the items, and the pivots as a small table."""
    spark = index.table.sparkSession
    rows = [(f, n, [float(v) for v in p]) for f, points in index.pivots.items() for n, p in enumerate(points)]
    spark.createDataFrame(rows, "feature string, n int, point array<double>").coalesce(1).write.parquet(f"{path.rstrip('/')}/pivots")
    index.table.write.parquet(f"{path.rstrip('/')}/items")


def load_index(spark: SparkSession, path: str) -> PivotIndex:
    pivots: dict[str, list] = {}
    for row in spark.read.parquet(f"{path.rstrip('/')}/pivots").orderBy("feature", "n").collect():
        pivots.setdefault(row.feature, []).append(row.point)
    return PivotIndex(spark.read.parquet(f"{path.rstrip('/')}/items"), {f: np.array(pivots[f]) for f in METRIC if f in pivots})


class _Bounds:
    """Enclosures of the distances of a batch of items to all queries, by feature."""

    def __init__(self, places: dict[str, np.ndarray]):
        self.query = places  # feature → queries x (coordinates, height)

    def __call__(self, batch: pa.RecordBatch):
        for n, (f, q) in enumerate(self.query.items()):
            x = batch.column(f"_p_{f}").flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
            size = np.linalg.norm(q, axis=1)[:, None] + np.linalg.norm(x, axis=1)[None, :]
            beside = sum((q[:, p, None] - x[None, :, p]) ** 2 for p in range(q.shape[1] - 1)) + np.zeros(size.shape)
            low = np.sqrt(beside + (q[:, -1:] - x[None, :, -1]) ** 2) - SLACK * size
            yield n, low, np.sqrt(beside + (q[:, -1:] + x[None, :, -1]) ** 2) + SLACK * size


def _flat(names: Sequence[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(names))


def _exact(index: PivotIndex, open_: DataFrame, points: dict[str, np.ndarray]) -> DataFrame:
    """``query_no, id, d_…``: the distances of the open pairs ``(query_no, id)``.

    Queries are gathered by item, so an item's vectors are read once; Spark sends the open
    items to all tasks if they are few, and shuffles by id if not.
    """
    features = list(points)
    asked = open_.groupBy("id").agg(F.collect_set("query_no").alias("asked"))
    items = index.table.select("id", *sources_of(features)).join(asked, "id")

    def score(batches):
        for batch in batches:
            asked = batch.column("asked")
            row = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
            query = asked.flatten().to_numpy(zero_copy_only=False)
            out = []
            for f in features:
                x = _points(f, batch.column(DISTANCES[f].source))
                gap = x[row] - points[f][query] if len(row) else np.zeros((0, 1))
                out.append(np.sqrt(np.einsum("ij,ij->i", gap, gap)))
            ids = batch.column("id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), ids, *map(pa.array, out)], ["query_no", "id", *[f"d_{f}" for f in features]])

    return items.mapInArrow(score, f"query_no int, id string, {', '.join(f'd_{f} double' for f in features)}")


def pivot_top_k(index: PivotIndex, songs: Sequence[str], k: int) -> tuple[DataFrame, Verified]:
    """``(query_id, id, aggregated)`` of each query's ``k`` best items, and what was verified.

    Equal to ``top_k`` of ``rank_batch`` over the index's features: scores are means of
    distances scaled between the least and the largest one, ties go to the smaller id. If
    all distances of a feature to a query are equal there are no scores; such a query is
    ranked in full. Queries must be items of the index.
    """
    parts, report = [], Verified(0, 0, 0)
    for queries in load_query_groups(index.table, list(dict.fromkeys(songs)), sources_of(index.features)):
        parts.append(_group_top_k(index, queries, k, report))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, report


def _group_top_k(index: PivotIndex, queries: dict[str, list], k: int, report: Verified) -> DataFrame:
    features, names = list(index.features), queries["id"]
    points = {f: _points(f, pa.array(queries[DISTANCES[f].source], pa.list_(pa.float64()))) for f in features}
    bounds = _Bounds({f: _places(points[f], index.pivots[f]) for f in features})
    slim = index.table.select("id", *[f"_p_{f}" for f in features])
    total = len(names)

    # The least distance is 0, since a query is an item. The largest one is at least that of
    # some far items, found by their bounds and then computed.
    def far_items(batches):
        value, name = np.full((2, len(features), total), -1.0), np.full((2, len(features), total), None, object)
        for batch in batches:
            for n, lower, upper in bounds(batch) if batch.num_rows else ():
                for side, bound in enumerate((lower, upper)):
                    top = bound.argmax(axis=1)
                    best = bound[np.arange(total), top]
                    for q in np.flatnonzero(best > value[side, n]).tolist():
                        value[side, n, q], name[side, n, q] = best[q], batch.column("id")[int(top[q])].as_py()
        side, f, q = np.nonzero(value >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in ((q, pa.int32()), (f * 2 + side, pa.int32()), (name[side, f, q].tolist(), pa.string()), (value[side, f, q], pa.float64()))],
            ["query_no", "f", "id", "bound"],
        )

    far = slim.mapInArrow(far_items, "query_no int, f int, id string, bound double").withColumn("bound", -F.col("bound"))
    seeds = top_k(far, SEEDS, "bound", ["query_no", "f"]).select("query_no", "id")
    low, high = np.zeros((len(features), total)), np.zeros((len(features), total))

    def raise_high(pairs):
        for r in _exact(index, pairs, points).groupBy("query_no").agg(*[F.max(f"d_{f}").alias(f) for f in features]).collect():
            for n, f in enumerate(features):
                high[n, r.query_no] = max(high[n, r.query_no], r[f])

    raise_high(seeds)
    least_high = high.copy()

    def could_be_largest(batches):
        for batch in batches:
            open_ = np.zeros((total, batch.num_rows), bool)
            for n, _, upper in bounds(batch) if batch.num_rows else ():
                open_ |= upper > least_high[n][:, None]
            query, row = np.nonzero(open_)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), batch.column("id").take(pa.array(row))], ["query_no", "id"])

    open_ = materialize(slim.mapInArrow(could_be_largest, "query_no int, id string"), "pivot-open")
    raise_high(open_)
    flat = {q for q in range(total) if (low[:, q] == high[:, q]).any()}
    span = np.where(high > low, high - low, 1.0)

    def means(batch):
        a, b = np.zeros((total, batch.num_rows)), np.zeros((total, batch.num_rows))
        for n, lower, upper in bounds(batch):
            a += np.clip((lower - low[n][:, None]) / span[n][:, None], 0, 1)
            b += np.clip((upper - low[n][:, None]) / span[n][:, None], 0, 1)
        return a / len(features) - SLACK, b / len(features) + SLACK

    def best_uppers(batches):
        held = np.full((total, 0), np.inf)
        for batch in batches:
            if batch.num_rows:
                held = np.concatenate([held, means(batch)[1]], axis=1)
                held = np.partition(held, k - 1, axis=1)[:, :k] if held.shape[1] > k else held
        yield _flat(("query_no", "upper"), np.repeat(np.arange(total, dtype=np.int32), held.shape[1]), held.ravel())

    uppers = slim.mapInArrow(best_uppers, "query_no int, upper double").withColumn("id", F.col("upper").cast("string"))
    limit = np.full(total, np.inf)
    kth = top_k(uppers, k, "upper", ["query_no"]).groupBy("query_no").agg(F.max("upper").alias("limit"), F.count(F.lit(1)).alias("n"))
    for r in kth.collect():
        limit[r.query_no] = r.limit if r.n == k else np.inf

    def could_be_best(batches):
        for batch in batches:
            query, row = np.nonzero(means(batch)[0] <= limit[:, None]) if batch.num_rows else (np.zeros(0, int), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), batch.column("id").take(pa.array(row))], ["query_no", "id"])

    best = materialize(slim.mapInArrow(could_be_best, "query_no int, id string"), "pivot-best")
    report.pairs += slim.count() * total
    report.for_scaling += open_.count()
    report.for_ranking += best.count()

    ends_of = [F.array(*[F.lit(float(v)) for v in x]) for n in range(len(features)) for x in (low[n], high[n])]
    score = F.lit(0.0)
    for n, f in enumerate(features):
        a, b = F.get(ends_of[2 * n], F.col("query_no")), F.get(ends_of[2 * n + 1], F.col("query_no"))
        score = score + (F.col(f"d_{f}") - a) / (b - a)
    exact = _exact(index, best.where(~F.col("query_no").isin(sorted(flat)) if flat else F.lit(True)), points)
    asked = F.array(*[F.lit(i) for i in names])
    scored = exact.select(F.get(asked, F.col("query_no")).alias("query_id"), "id", (score / len(features)).alias("aggregated"))
    out = top_k(scored, k, by=["query_id"])
    if flat:
        rest = rank_batch(index.table, [names[q] for q in sorted(flat)], features).select("query_id", "id", "aggregated")
        out = out.unionByName(top_k(rest, k, by=["query_id"]))
    return out
