"""Exact top-k inner products over vectors grouped by length.

Vectors of like length (within ``RATIO``) form a bucket; a bucket is dealt out in
cells of bounded size by a hash of the id, so many equal vectors do not meet in one
task. Every query gets a first threshold from the ``SEEDS`` longest vectors, a bounded
set that is sent to all tasks; buckets too short for it are skipped, and only cells that
some query of a block can need are copied to it.

In a cell a query's threshold is raised first, by the exact products of the ``FIRST`` rows
that look best. The bucket's local cosine threshold follows from it, by the query's length
and the longest vector there. Where it is low, the query prunes by length alone. Where it
is high it prunes by coordinates: with the query's largest coordinates F of both unit
vectors, q.x <= q_F.x_F + |q_rest| |x_rest|. The bound is computed from a few coordinates
for all rows, and from twice as many for those that are left, until half the coordinates
are used. What remains is verified by exact products of whole numbers, in doubles, 64-bit
or unbounded integers as their size demands. Blocks of queries meet cells of vectors; no
task holds more than a block and a cell.

Defined results: vectors that are NULL, hold a NULL or a non-finite component, and rows
without an id, take no part; a score of more than 38 digits or a squared length beyond a
double is an error; vectors of different dimension do not meet; an empty vector is of
length 0; rows that repeat an id are partners of their own, and as queries share one list,
of the pairs of all of them; a row never meets one of its own id; equal products are
ordered by the smaller id; a query with fewer than k partners gets them all; empty tables
give no rows.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from echorank.llm.tables import written

RATIO, CELL_ROWS, QUERY_ROWS, SEEDS, FIRST = 1.1, 16384, 16384, 512, 32
#: Local threshold from which coordinates prune better than lengths, and how many are used first.
COORDINATES_FROM, COORDINATES = 0.2, 8
#: The type of scores, and the doubles from which on all are whole numbers.
SCORE, WHOLE_FROM = "decimal(38,0)", 2.0**52
#: Allowance for rounding in bounds; a bound has to be missed by more.
SLACK = 1e-9


def whole(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x), as doubles, which hold them exactly; NULL for a vector that takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    made = F.transform(scaled, lambda y: F.when(F.abs(y) < F.lit(WHOLE_FROM), F.floor(y).cast("double")).otherwise(y))
    return F.when(fine, made)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(scores) > 8 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles hold them if no partial sum leaves 2**53, 64 bits up to 2**62, Python's integers all."""
    bound = np.abs(rows).max(axis=1, initial=0) * (np.abs(query).max(initial=0) * max(1, len(query)))
    if bound.max(initial=0) < 2**53:
        return (rows @ query).astype(np.int64)
    out = np.zeros(len(rows), np.int64)
    middle = bound < 2**62
    if np.abs(query).max(initial=0) < 2**62:
        out[middle] = rows[middle].astype(np.int64) @ query.astype(np.int64)
    if not middle.all():
        out, own = out.astype(object), [int(x) for x in query]
        for i in np.flatnonzero(~middle).tolist():
            out[i] = sum(int(x) * y for x, y in zip(rows[i], own))
    return out


def below(score: int) -> float:
    """The score as a double that is not above it."""
    return float(score) if abs(score) <= 2**53 else float(np.nextafter(float(score), -np.inf))


def decimals(scores: np.ndarray) -> pa.Array:
    whole_numbers = pa.decimal128(38, 0)
    return pa.array(scores).cast(whole_numbers) if scores.dtype == np.int64 else pa.array([Decimal(int(x)) for x in scores], whole_numbers)


class Cell:
    """Vectors of like length: longest first, and their unit vectors by coordinate."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, longest: float):
        length = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.rows, self.length, self.longest = ids[order], rows[order].astype(float), length[order], longest
        self.unit = np.ascontiguousarray((self.rows / np.maximum(self.length, 1e-300)[:, None]).T)
        self.verified = 0

    def verify(self, some: np.ndarray | slice, query: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact products of some rows, the query's own id left out."""
        ids = self.ids[some]
        self.verified += len(ids)
        scores = products(self.rows[some], query)
        return ids[ids != own], scores[ids != own]

    def top(self, query: np.ndarray, own: int, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of the cell that reach the threshold."""
        size = float(np.sqrt(query @ query))
        n = len(self.ids)
        if size == 0 or n <= FIRST:
            ids, scores = self.verify(slice(None), query, own)
        else:
            unit = query / size
            order = np.argsort(-np.abs(unit), kind="stable")
            used = min(COORDINATES, len(unit))
            x = self.unit[order[:used]]
            part, energy = unit[order[:used]] @ x, np.einsum("ij,ij->j", x, x)
            looks = part * self.length
            first = np.argpartition(-looks, FIRST)[:FIRST]
            score = np.sort(self.verify(first, query, own)[1])
            if len(score) >= k:
                threshold = max(threshold, below(score[-k]))
            some = self.candidates(unit, order, used, part, energy, size, threshold)
            ids, scores = self.verify(some, query, own)
        keep = scores >= threshold if np.isfinite(threshold) else slice(None)
        return best(ids[keep], scores[keep], k)

    def candidates(
        self, unit: np.ndarray, order: np.ndarray, used: int, part: np.ndarray, energy: np.ndarray, size: float, threshold: float
    ) -> np.ndarray | slice:
        """Rows that can reach the threshold, by length or by the coordinates used so far and more."""
        if not np.isfinite(threshold):
            return slice(None)
        local = threshold / (size * max(self.longest, 1e-300))
        if local < COORDINATES_FROM:
            short = int(np.searchsorted(-self.length, -threshold / size * (1 - SLACK), "right")) if threshold > 0 else len(self.ids)
            return slice(0, short)
        some = None
        while True:
            rest = np.sqrt(max(0.0, 1 - float(unit[order[:used]] @ unit[order[:used]])))
            length = self.length if some is None else self.length[some]
            bound = (part + rest * np.sqrt(np.maximum(0, 1 - energy)) + SLACK) * length * size
            stay = np.flatnonzero(bound >= threshold)
            some, part, energy = stay if some is None else some[stay], part[stay], energy[stay]
            more = min(2 * used, len(unit))
            if used >= len(unit) // 2 or not len(some):
                return some
            x = self.unit[order[used:more]][:, some]
            part, energy, used = part + unit[order[used:more]] @ x, energy + np.einsum("ij,ij->j", x, x), more


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten())
    return flat.reshape(-1, width) if width else np.zeros((len(column), 0))


def search(vectors: DataFrame, is_query: Column, k: int, scale: int, verified: Accumulator | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score (decimal)`` for every query among ``vectors (vec_id, embedding)``.

    ``verified`` is raised by the number of exact products in cells.
    """
    v = whole(F.col("embedding"), scale)
    rows = (
        vectors.where(F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
        .where(F.col("v").isNotNull())
        .withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        .withColumn("square", F.when(F.col("square") < F.lit(math.inf), F.col("square")).otherwise(F.raise_error(F.lit("a vector's squared length is beyond a double")).cast("double")))
        .withColumn("dim", F.size("v"))
        .withColumn("bucket", F.when(F.col("square") > 0, F.floor(F.log("square") / (2 * np.log(RATIO)))).otherwise(-1).cast("int"))
    )
    rows = written(rows, "topk-vectors")
    # A bucket spans a fixed ratio of lengths, so there are a few hundred at most a dimension.
    found = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("square").alias("most")).orderBy("dim", F.desc("bucket")).collect()
    buckets, cells = [], 0
    for r in found:
        parts = -(-r["n"] // CELL_ROWS)
        buckets.append((r["dim"], r["bucket"], cells, parts, float(np.sqrt(r["most"]))))
        cells += parts
    queries = rows.where("is_query")
    n_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    seeds = {
        dim: rows.where(F.col("dim") == dim).orderBy(F.desc("square"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
        for dim in sorted({b[0] for b in buckets})
    }
    sent = rows.sparkSession.sparkContext.broadcast((seeds, buckets))

    def first_thresholds(batches):
        seeds, buckets = sent.value
        for batch in batches:
            ids, dims, values = np.asarray(batch.column("vec_id")), np.asarray(batch.column("dim")), batch.column("v")
            threshold, alive = [], []
            for i, (own, dim) in enumerate(zip(ids.tolist(), dims.tolist())):
                q = np.asarray(values[i].values, float)
                other = np.asarray(seeds[dim]["vec_id"])
                scores = products(matrix(seeds[dim]["v"], dim).astype(float), q)[other != own]
                _, top = best(other[other != own], scores, k)
                t = below(top[-1]) if len(top) == k else -np.inf
                size = float(np.sqrt(q @ q))
                threshold.append(t)
                alive.append([c for d, _, at, parts, longest in buckets if d == dim and size * longest * (1 + SLACK) >= t for c in range(at, at + parts)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), values, pa.array(threshold, pa.float64()), pa.array(alive, pa.list_(pa.int32()))],
                ["vec_id", "v", "threshold", "cells"],
            )

    thresholds = queries.select("vec_id", "v", "dim").mapInArrow(first_thresholds, "vec_id long, v array<double>, threshold double, cells array<int>")
    left = written(thresholds, "topk-queries").select(
        "vec_id", "v", "threshold", F.explode("cells").alias("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block")
    )
    places = rows.sparkSession.createDataFrame([b[:4] for b in buckets], "dim int, bucket int, at int, parts int") if buckets else None
    if places is None:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {SCORE}")
    at = (F.col("at") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")
    live = left.select("cell", "block").distinct()  # blocks and the cells that any of their queries needs
    right = (
        rows.join(F.broadcast(places), ["dim", "bucket"])
        .select("vec_id", "v", F.lit(None).cast("double").alias("threshold"), at.alias("cell"))
        .join(live, "cell")
        .select("vec_id", "v", "threshold", "cell", "block")
    )

    def meet(group: pa.Table) -> pa.Table:
        _, buckets = sent.value
        cell = group["cell"][0].as_py()
        dim, longest = next((d, m) for d, _, at, parts, m in buckets if at <= cell < at + parts)
        ids, values = np.asarray(group["vec_id"]), matrix(group["v"], dim)
        asks = ~np.asarray(group["threshold"].is_null())
        threshold = np.asarray(group["threshold"].fill_null(0.0))
        out: list[list[np.ndarray]] = [[], [], []]
        if (~asks).any():
            c = Cell(ids[~asks], values[~asks], longest)
            for i in np.flatnonzero(asks).tolist():
                top, score = c.top(values[i].astype(float), int(ids[i]), float(threshold[i]), k)
                for column, a in zip(out, (np.full(len(top), ids[i]), top, score)):
                    column.append(a)
            if verified is not None:
                verified.add(c.verified)
        query_id, other, score = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in out)
        return pa.table([query_id.astype(np.int64), other.astype(np.int64), decimals(score)], ["query_id", "vec_id", "score"])

    pairs = left.unionByName(right).groupBy("cell", "block").applyInArrow(meet, f"query_id long, vec_id long, score {SCORE}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
