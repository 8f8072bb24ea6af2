"""Edit distance search through an inverted index of q-grams.

One edit changes at most q of a text's q-grams. Two texts within distance d therefore differ
by at most d in length, and share at least max(length) - q + 1 - d q of their grams, counted
with repeats. Lists of (gram, item, count) are stored sorted by gram: a query reads those of
its own grams, adds up the shared counts by item, and only items that pass both filters have
their edit distance computed. Where the share needed is no more than nothing (d is large for
the length) the grams say nothing, and all items of fitting length are compared.

Grams are 64-bit hashes; a collision can only add a candidate. Everything is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.kernels import edit_distances_to
from ..operators.ordering import top_k
from ..operators.pairing import load_query_groups
from ..session import materialize

# Length of a gram, and the distance that a search for the nearest items begins with.
GRAM, FIRST = 4, 4
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class GramIndex:
    """``items (id, notes, length)`` sorted by length, ``grams (gram, id, length, n)`` sorted by gram."""

    items: DataFrame
    grams: DataFrame
    q: int


def grams_of(text: str, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a text as hashes, and how often each occurs."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = max(0, len(codes) - q + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(q):
        rolled = rolled * _MULTIPLIER + codes[k : k + n]
    rolled ^= rolled >> np.uint64(31)
    found, count = np.unique(rolled * _MULTIPLIER, return_counts=True)
    return found.view(np.int64), count


def build_gram_index(notes: DataFrame, q: int = GRAM, text: str = "notes") -> GramIndex:
    """The index of ``(id, notes)``, written once; rows without an id or text are left out."""
    rows = notes.where(F.col("id").isNotNull() & F.col(text).isNotNull()).select("id", F.col(text).alias("notes"), F.length(text).alias("length"))

    def cut(batches):
        for batch in batches:
            for name, length, value in zip(*[batch.column(c).to_pylist() for c in ("id", "length", "notes")]):
                grams, count = grams_of(value, q)
                if len(grams):
                    same = [pa.repeat(pa.scalar(v, t), len(grams)) for v, t in ((name, pa.string()), (length, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([pa.array(grams), *same, pa.array(count.astype(np.int32))], ["gram", "id", "length", "n"])

    rows = rows.dropDuplicates() if not rows.groupBy("id").count().where("count > 1").isEmpty() else rows
    items = materialize(rows.repartitionByRange("length", "id").sortWithinPartitions("length"), "gram-items")
    # The counts of several texts of one id and length add up, which only adds candidates.
    lists = items.mapInArrow(cut, "gram long, id string, length int, n int")
    grams = lists.repartitionByRange("gram", "id").sortWithinPartitions("gram")
    return GramIndex(items, materialize(grams, "gram-lists"), q)


def save_gram_index(index: GramIndex, path: str) -> None:
    path = path.rstrip("/")
    index.items.write.parquet(f"{path}/items")
    index.grams.write.parquet(f"{path}/grams-{index.q}")


def load_gram_index(spark: SparkSession, path: str, q: int = GRAM) -> GramIndex:
    path = path.rstrip("/")
    return GramIndex(spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/grams-{q}"), q)


def _needed(q: int, length: Column, other: Column, d: Column) -> Column:
    return F.greatest(length, other) - q + 1 - d * q


def candidates(index: GramIndex, asked: Sequence[tuple[int, str, int]]) -> DataFrame:
    """``query_no, id``: the items that may lie within ``d`` of ``(query_no, text, d)``.

    The queries' grams are a broadcast table; their texts have been checked for size when
    they were loaded, and a gram takes no more room than a character.
    """
    spark, q = index.items.sparkSession, index.q
    rows, lengths = [], []
    for number, text, d in asked:
        lengths.append((number, len(text), d))
        rows += [(number, len(text), d, int(g), int(n)) for g, n in zip(*grams_of(text, q))]
    own = spark.createDataFrame(lengths, "query_no int, own int, d int")
    windows = F.lit(False)
    for _, length, d in lengths:
        windows = windows | F.col("length").between(length - d, length + d)
    fits = F.abs(F.col("length") - F.col("own")) <= F.col("d")
    need = _needed(q, F.col("length"), F.col("own"), F.col("d"))
    silent = F.greatest(*[F.lit(q - 1 + d * q) for _, _, d in lengths]) if len(lengths) > 1 else F.lit(q - 1 + lengths[0][2] * q)
    short = index.items.select("id", "length").where(windows & (F.col("length") <= silent))
    loose = short.join(F.broadcast(own), fits & (need <= 0)).select("query_no", "id")
    if not rows:
        return loose.distinct()
    wanted = F.broadcast(spark.createDataFrame(rows, "query_no int, own int, d int, gram long, mine int"))
    lists = index.grams.where(windows & F.col("gram").isin([r[3] for r in rows]) if len(rows) <= 1000 else windows)
    shared = lists.join(wanted, "gram").where(fits).groupBy("query_no", "id", "length", "own", "d")
    tight = shared.agg(F.sum(F.least("n", "mine")).alias("common")).where((F.col("common") >= need) & (need > 0)).select("query_no", "id")
    return tight.unionByName(loose).distinct()


def _verified(index: GramIndex, open_: DataFrame, texts: list[str]) -> DataFrame:
    """``query_no, id, distance`` of the open pairs; an item's text is read once for all its queries."""
    asked = open_.groupBy("id").agg(F.collect_set("query_no").alias("asked"))
    items = index.items.select("id", "notes").join(asked, "id")

    def score(batches):
        for batch in batches:
            ids, notes, queries = [batch.column(c).to_pylist() for c in ("id", "notes", "asked")]
            by_query: dict[int, list[int]] = {}
            for row, numbers in enumerate(queries):
                for number in numbers:
                    by_query.setdefault(number, []).append(row)
            for number, rows in by_query.items():
                (distance,) = edit_distances_to([notes[r] for r in rows], [texts[number]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(rows), pa.int32()), pa.array([ids[r] for r in rows]), pa.array(distance)], ["query_no", "id", "distance"]
                )

    return items.mapInArrow(score, "query_no int, id string, distance double")


def _named(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    asked = F.array(*[F.lit(i) for i in ids])
    return rows.select(F.get(asked, F.col("query_no")).alias("query_id"), "id", "distance").distinct()


def edit_within(index: GramIndex, songs: Sequence[str], d: int) -> DataFrame:
    """``query_id, id, distance`` of all items within ``d`` edits of each query item."""
    parts = None
    for queries in load_query_groups(index.items, list(dict.fromkeys(songs)), ["notes"]):
        texts = queries["notes"]
        open_ = candidates(index, [(n, t, d) for n, t in enumerate(texts)])
        found = _named(_verified(index, open_, texts).where(F.col("distance") <= d), queries["id"])
        parts = found if parts is None else parts.unionByName(found)
    return parts


def edit_nearest(index: GramIndex, songs: Sequence[str], k: int, first: int = FIRST) -> tuple[DataFrame, int]:
    """``query_id, id, distance`` of each query's ``k`` nearest items, and how many pairs were verified.

    Ties go to the smaller id. The distance doubles for the queries that have not found
    ``k`` items within it yet, until it spans every length there is.
    """
    longest = index.items.agg(F.max("length")).first()[0] or 0
    out, verified = [], 0
    for queries in load_query_groups(index.items, list(dict.fromkeys(songs)), ["notes"]):
        texts, open_, d = queries["notes"], list(range(len(queries["id"]))), first
        while open_:
            last = d >= max(longest, max(len(texts[n]) for n in open_))
            pairs = materialize(candidates(index, [(n, texts[n], d) for n in open_]), "gram-pairs")
            verified += pairs.count()
            near = materialize(_verified(index, pairs, texts).where(F.col("distance") <= d).distinct(), "gram-near")
            n_found = {r.query_no: r["count"] for r in near.groupBy("query_no").count().collect()}
            done = [n for n in open_ if last or n_found.get(n, 0) >= k]
            if done:
                out.append(_named(near.where(F.col("query_no").isin(done)), queries["id"]))
            open_, d = [n for n in open_ if n not in done], d * 2
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return top_k(rows, k, "distance", ["query_id"]), verified
