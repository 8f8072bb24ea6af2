"""Dimension-sharded Lloyd clustering of integer vectors, exact.

The columns of the vectors are cut in blocks and the rows in chunks; one record holds a
chunk's numbers of one block. A task of a block sees only that block's slice of the
centroids: it computes partial squared distances, the partials of a chunk are added by
key and the smallest total is taken. The labels go back to the blocks, every block sums
its own columns by cluster, and its shard of the model is updated alone.

What moves in a round: the partial distances (a number per vector, block and centroid)
and the labels. The blocks do not: they are a table bucketed by block and chunk, and only
labels are sent to them. The model is ``k`` times the number of dimensions, a parameter;
slices travel in the tasks' closures. Every number is an integer: doubles where all
results are below 2**53, 64-bit sums, unbounded integers beyond.

Defined results: rows whose vector is NULL, of another length, or holds NULL, NaN or an
infinity take no part. Equal distances go to the smaller number. Repeated rows and keys
are rows like others, a NULL key too. With fewer rows than centroids there are as many
centroids as rows; an empty table gives an empty result. Extra columns are ignored. A
component or a distance of more than 38 digits fails the job.
"""

from __future__ import annotations

import json
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echorank.llm.tables import written
from echorank.session import scratch_path

#: Columns of a block, rows of a chunk, bytes of blocks in one bucket.
WIDTH, CHUNK_ROWS, BUCKET_BYTES = 32, 1024, 64 << 20
#: Doubles hold every integer below this.
EXACT = 2.0**53

Slices = dict[int, bytes]
_WHOLE = pa.decimal128(38, 0)


def pack(values: np.ndarray) -> bytes:
    """Integers as the narrowest fixed width that holds them, else as text."""
    if values.dtype != object:
        low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
        for code in "bhiq":
            if np.iinfo(code).min <= low and high <= np.iinfo(code).max:
                return code.encode() + values.astype(code).tobytes()
    return b"o" + json.dumps([int(v) for v in values.ravel()]).encode()


def unpack(data: bytes, width: int) -> np.ndarray:
    """A matrix of 64-bit integers, of Python integers where those do not hold it."""
    if data[:1] == b"o":
        return np.array(json.loads(data[1:]), object).reshape(-1, width)
    return np.frombuffer(data, data[:1].decode(), offset=1).astype(np.int64).reshape(-1, width)


def whole(values: np.ndarray) -> np.ndarray:
    """Integer-valued doubles as integers."""
    if not np.isfinite(values).all():
        raise ValueError("a scaled component leaves the range of doubles")
    if values.size == 0 or np.abs(values).max() < EXACT:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def partial_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each row of ``c``, exact."""
    reach = float(abs(x).max(initial=0)) + float(abs(c).max(initial=0))
    if x.shape[1] * reach * reach < EXACT:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    a, b = x.astype(object), c.astype(object)
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1)


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.when(F.size(vector) == dims, fine), F.lit(False))


def seeds(rows: DataFrame, key: str, vector: str, k: int, salt: str, scale: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of their keys; rows without a key come last."""
    order = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), F.col(vector)).select(vector).limit(k)
    return [[math.floor(scale * float(v)) for v in row[0]] for row in first.collect()]


def _blocks(rows: DataFrame, key: str, vector: str, dims: int, scale: int, width: int, chunk_rows: int) -> DataFrame:
    """Records of a chunk and a block; the first block of a chunk also holds its keys."""
    def cut(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                piece = batch.slice(at, chunk_rows)
                flat = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                x = whole(np.floor(flat * scale)).reshape(-1, dims)
                keys = pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), piece.column(0))
                starts = range(0, dims, width)
                empty = pa.nulls(len(starts) - 1, keys.type)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk] * len(starts), pa.int64()),
                        pa.array(range(len(starts)), pa.int32()),
                        pa.array([pack(x[:, s : s + width]) for s in starts], pa.binary()),
                        pa.concat_arrays([keys, empty]),
                    ],
                    ["chunk", "block", "data", "keys"],
                )
                chunk += 1

    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("data", T.BinaryType()),
            T.StructField("keys", T.ArrayType(rows.schema[key].dataType)),
        ]
    )
    return rows.select(key, vector).mapInArrow(cut, schema)


def _bucketed(blocks: DataFrame) -> tuple[DataFrame, str]:
    """The blocks as a table bucketed by block and chunk, outside the catalogue's own folder."""
    spark = blocks.sparkSession
    plain = written(blocks, "lloyd-blocks")
    size = plain.agg(F.sum(F.length("data"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    path = scratch_path(spark, "llm-lloyd-buckets")
    name = "lloyd_" + path.rsplit("-", 1)[1]
    stored = plain.repartition(n, "block", "chunk").write.bucketBy(n, "block", "chunk").option("path", path)
    stored.saveAsTable(name)
    return spark.table(name), name


def _nearest(blocks: DataFrame, slices: Slices, widths: list[int], k: int) -> DataFrame:
    """Per chunk the labels and distances of its rows: partials of all blocks, added by chunk."""

    def partials(batches):
        for batch in batches:
            out = []
            for block, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                c = unpack(slices[block], widths[block])
                out.append(pack(partial_distances(unpack(data, widths[block]), c)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["chunk", "partial"])

    def reduce(table: pa.Table) -> pa.Table:
        total = None
        for data in table.column("partial"):
            part = unpack(data.as_py(), k)
            total = part if total is None else total + part
        labels = np.argmin(total, 1)
        least = total[np.arange(len(total)), labels]
        return pa.table(
            {
                "chunk": table.column("chunk").slice(0, 1),
                "labels": pa.array([pack(labels)], pa.binary()),
                "distances": pa.array([pack(least)], pa.binary()),
            }
        )

    shared = blocks.select("chunk", "block", "data").mapInArrow(partials, "chunk long, partial binary")
    return shared.groupBy("chunk").applyInArrow(reduce, "chunk long, labels binary, distances binary")


def _updated(blocks: DataFrame, best: DataFrame, slices: Slices, widths: list[int], k: int) -> Slices:
    """Each block's slice of the centroids after the vectors' means are taken."""

    def sums(batches):
        held = {}
        for batch in batches:
            for block, data, labels in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                x, label = unpack(data, widths[block]), unpack(labels, 1)[:, 0]
                if x.dtype != object and float(abs(x).max(initial=0)) * len(x) >= EXACT:
                    x = x.astype(object)
                order = np.argsort(label, kind="stable")
                used, first, n = np.unique(label[order], return_index=True, return_counts=True)
                counts, total = held.setdefault(block, ([0] * k, [[0] * widths[block] for _ in range(k)]))
                for c, rows, row in zip(used.tolist(), n.tolist(), np.add.reduceat(x[order], first).tolist()):
                    counts[c] += rows
                    total[c] = [a + b for a, b in zip(total[c], row)]
        rows = [(b, c, n[c], s[c]) for b, (n, s) in held.items() for c in range(k) if n[c]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([[Decimal(v) for v in r[3]] for r in rows], pa.list_(_WHOLE)),
            ],
            ["block", "cluster", "n", "sums"],
        )

    def update(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        c = unpack(slices[block], widths[block]).astype(object)
        for cluster, pos, n, s in zip(*[table.column(x).to_pylist() for x in ("cluster", "pos", "n", "s")]):
            c[cluster, pos] = int(s) // n
        try:
            c = c.astype(np.int64)
        except OverflowError:
            pass
        return pa.table({"block": pa.array([block], pa.int32()), "slice": pa.array([pack(c)], pa.binary())})

    to_blocks = best.select("chunk", "labels", F.explode(F.sequence(F.lit(0), F.lit(len(widths) - 1))).alias("block"))
    mine = blocks.select("chunk", "block", "data").join(to_blocks, ["block", "chunk"]).select("block", "data", "labels")
    summed = (
        mine.mapInArrow(sums, "block int, cluster int, n long, sums array<decimal(38,0)>")
        .select("block", "cluster", "n", F.posexplode("sums").alias("pos", "s"))
        .groupBy("block", "cluster", "pos")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    )
    changed = summed.groupBy("block").applyInArrow(update, "block int, slice binary")
    return {**slices, **{row["block"]: bytes(row["slice"]) for row in changed.collect()}}


def lloyd(
    rows: DataFrame,
    key: str,
    vector: str,
    centroids: list[list[int]],
    rounds: int,
    scale: int = 1,
    width: int = WIDTH,
    chunk_rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, list[list[int]]]:
    """``rounds`` rounds from the given centroids, then a last assignment.

    Vectors are floor(scale * x); ``rows`` holds usable ones only. Returns the rows
    ``(key, cluster, distance)``, the squared distance as a decimal of 38 digits, and the
    final centroids.
    """
    if key in ("cluster", "distance"):
        raise ValueError(f"the key column may not be called {key}")
    spark, key_type = rows.sparkSession, rows.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.DecimalType(38, 0)),
        ]
    )
    if not centroids:
        return spark.createDataFrame([], schema), []
    k, dims = len(centroids), len(centroids[0])
    model = whole(np.array(centroids, float)) if max(abs(v) for c in centroids for v in c) < EXACT else np.array(centroids, object)
    starts = list(range(0, dims, width))
    widths = [min(width, dims - s) for s in starts]
    slices = {b: pack(model[:, s : s + width]) for b, s in enumerate(starts)}

    blocks, name = _bucketed(_blocks(rows, key, vector, dims, scale, width, chunk_rows))
    for _ in range(rounds):
        slices = _updated(blocks, _nearest(blocks, slices, widths, k), slices, widths, k)

    def unroll(batches):
        for batch in batches:
            for keys, labels, distances in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                label, d = unpack(labels, 1)[:, 0], unpack(distances, 1)[:, 0]
                whole_d = pa.array(d, pa.int64()).cast(_WHOLE) if d.dtype != object else pa.array([Decimal(v) for v in d], _WHOLE)
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(label, pa.int32()), whole_d], [key, "cluster", "distance"])

    named = blocks.where("block = 0").select("chunk", "keys")
    best = named.join(_nearest(blocks, slices, widths, k), "chunk").select("keys", "labels", "distances")
    assigned = written(best.mapInArrow(unroll, schema), "lloyd-assigned")
    spark.sql(f"DROP TABLE {name}")
    final = np.concatenate([unpack(slices[b], widths[b]).astype(object) for b in range(len(starts))], 1)
    return assigned, [[int(v) for v in row] for row in final]
