"""Whether files hold the same ids in the same order.

Rows of a DataFrame have no order, lines of a file do: Spark knows for every line the file
and the offset of the split it came from, and a task reads a split from front to back. A
split is reduced to the number of its lines and a polynomial of their ids, and pieces merge
by their lengths, so the fingerprint of a file does not depend on how it was split or into
how many part files it was written. Only a few numbers per split are shuffled. Two orders
share a fingerprint with a chance of about 2**-62.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialize
from .integrity import LISTED, order_consistency

# Two primes below 2**31, so that products fit 64 bits, and a base for each.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_001)


def id_lines(spark: SparkSession, path: str, id_column: int = 0, sep: str = ",") -> DataFrame:
    """``file, block, piece, id`` of the lines of a feature CSV; blank lines do not count.

    ``piece`` is a number that the lines of one split share.
    """
    from ..sources.tables import split_fields

    at = F.lit(id_column + 1 if id_column >= 0 else id_column)
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select("value", file.alias("file"), block.alias("block")).where(F.trim("value") != "")
    return lines.select("file", "block", F.xxhash64("file", "block").alias("piece"), F.try_element_at(split_fields(F.col("value"), sep), at).alias("id"))


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    """``base**0 … base**(n-1)`` by doubling."""
    out, known = np.ones(n, np.uint64), 1
    while known < n:
        more = min(known, n - known)
        out[known : known + more] = out[:more] * np.uint64(pow(base, known, prime)) % np.uint64(prime)
        known += more
    return out


def _runs(piece: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
    return zip(edges, edges[1:])


def order_pieces(lines: DataFrame) -> DataFrame:
    """``file, block, n, h0, h1``: one row per split."""

    def task(batches):
        held = None  # piece, file, block, n, h0, h1

        def out(row):
            columns = [pa.array([v], t) for v, t in zip(row[1:], (pa.string(), *[pa.int64()] * 4))]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "h0", "h1"])

        for batch in batches:
            piece, hashes = np.asarray(batch.column("piece")), np.asarray(batch.column("h")).view(np.uint64)
            for a, b in _runs(piece) if len(piece) else ():
                sums = []
                for base, prime in zip(BASES, PRIMES):
                    terms = hashes[a:b] % np.uint64(prime) * _powers(b - a, base, prime) % np.uint64(prime)
                    sums.append(int(terms.sum()) % prime)
                if held is not None and held[0] == piece[a]:
                    n = held[3]
                    merged = [(h + s * pow(base, n, prime)) % prime for h, s, base, prime in zip(held[4:], sums, BASES, PRIMES)]
                    held = (*held[:3], n + b - a, *merged)
                else:
                    if held is not None:
                        yield out(held)
                    held = (piece[a], batch.column("file")[a].as_py(), batch.column("block")[a].as_py(), b - a, *sums)
        if held is not None:
            yield out(held)

    hashed = lines.select("file", "block", "piece", F.xxhash64("id").alias("h"))
    return hashed.mapInArrow(task, "file string, block long, n long, h0 long, h1 long")


def _offsets(pieces: DataFrame) -> DataFrame:
    """With the number of lines before each piece; a row per split, so one task per table can hold them."""
    before = Window.partitionBy("table").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def order_fingerprints(spark: SparkSession, paths: Mapping[str, str], id_column: int = 0, sep: str = ",") -> DataFrame:
    """``table, lines, fingerprint`` of feature CSVs; part files count in the order of their names."""
    parts = None
    for name, path in paths.items():
        own = order_pieces(id_lines(spark, path, id_column, sep)).withColumn("table", F.lit(name))
        parts = own if parts is None else parts.unionByName(own)

    def shift(batches):
        for batch in batches:
            moved = []
            for h, base, prime in zip(("h0", "h1"), BASES, PRIMES):
                rows = zip(batch.column(h).to_pylist(), batch.column("before").to_pylist())
                moved.append(pa.array([v * pow(base, n, prime) % prime for v, n in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("table"), batch.column("n"), *moved], ["table", "n", "h0", "h1"])

    moved = _offsets(parts).select("table", "n", "h0", "h1", "before").mapInArrow(shift, "table string, n long, h0 long, h1 long")
    whole = [F.lpad(F.lower(F.hex(F.sum(h) % prime)), 8, "0") for h, prime in zip(("h0", "h1"), PRIMES)]
    return moved.groupBy("table").agg(F.sum("n").alias("lines"), F.concat(*whole).alias("fingerprint"))


def numbered_ids(spark: SparkSession, path: str, id_column: int = 0, sep: str = ",") -> DataFrame:
    """``position, id`` of the lines of a feature CSV, from 0."""

    def number(batches):
        last, n = None, 0
        for batch in batches:
            piece = np.asarray(batch.column("piece"))
            at = np.empty(len(piece), np.int64)
            for a, b in _runs(piece) if len(piece) else ():
                n = n if piece[a] == last else 0
                at[a:b] = np.arange(n, n + b - a)
                last, n = piece[a], n + b - a
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(at), batch.column("id")], ["file", "block", "i", "id"])

    lines = id_lines(spark, path, id_column, sep)
    rows = lines.mapInArrow(number, "file string, block long, i long, id string")
    starts = _offsets(order_pieces(lines).withColumn("table", F.lit(""))).select("file", "block", "before")
    return rows.join(starts, ["file", "block"]).select((F.col("before") + F.col("i")).alias("position"), "id")


def order_differences(spark: SparkSession, paths: Mapping[str, str], id_column: int = 0, sep: str = ",") -> DataFrame:
    """``position, id`` and how often each table has that id there, where tables differ.

    Nothing but the fingerprints is computed as long as they agree; then the result is empty.
    """
    found = [(r.lines, r.fingerprint) for r in order_fingerprints(spark, paths, id_column, sep).collect()]
    if len(set(found)) <= 1 and len(found) in (0, len(paths)):  # a file without lines has no row
        columns = ", ".join(["position long", "id string", *[f"`{n}` long" for n in paths]])
        return spark.createDataFrame([], columns)
    return order_consistency({n: numbered_ids(spark, p, id_column, sep) for n, p in paths.items()})


def check_file_order(spark: SparkSession, paths: Mapping[str, str], id_column: int = 0, sep: str = ",") -> None:
    """Raise unless the files hold the same ids in the same order; the first places are named."""
    wrong = materialize(order_differences(spark, paths, id_column, sep), "order")
    listed = [f"line {r.position + 1}: {r.id} {[r[n] for n in paths]}" for r in wrong.orderBy("position", "id").limit(LISTED).collect()]
    if listed:
        raise ValueError(f"order of ids differs across {list(paths)}: {'; '.join(listed)}")
