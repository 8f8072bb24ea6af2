"""Near-duplicate texts: circulant MinHash, banding, exact Jaccard verification.

A text's set is its distinct word shingles as 64-bit hashes. Two fixed permutations
make all signature coordinates: ``sigma`` shuffles the universe once, and coordinate
k is the minimum of ``pi`` shifted circularly by k. Both are bijections of the 32-bit
numbers onto themselves. Texts that agree in all rows of a band are candidates, and a
link is confirmed on the full sets.

Equal sets are one class from the start and are never compared. In a bucket every
member is compared with the smallest one first; links become components. Only buckets
that still hold several components go on: up to ``LEADERS`` of the members outside
the largest component are compared with all others, part by part of bounded size, and
are then done. This goes on until the rest of each bucket is one component, so every
pair of different components has been tested. A group of near copies costs about one
comparison a member, no bucket is capped, and no task holds a bucket.

A link of similarity 0.8 is missed with a probability of (1 - 0.8**4)**32 = 5e-8.

Defined results: texts without words have no set and are linked with nothing; fewer
words than a shingle make one of all of them; a row with a NULL id is its own
component, named NULL; repeated rows share a class. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echorank.llm.components import components, salted_join
from echorank.llm.tables import written
from echorank.llm.words import SPACED, Hasher, cut, mix, slices

BANDS, ROWS = 32, 4
#: Shingles whose coordinates are computed together.
BLOCK = 4096
#: Members of a bucket compared with all the others in one round, and bytes of sets in a part of it.
LEADERS, PART_BYTES = 256, 8 << 20

_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int, hasher: Hasher) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = cut(texts, SPACED, hasher)
    h = words.hashes
    whole = max(0, len(h) - size + 1)
    rolled = np.zeros(whole, np.uint64)
    for k in range(size):
        rolled += h[k : k + whole] * _ODD[k % 64]
    rolled = mix(rolled)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
        elif b > a:
            short = (h[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def sigma(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def pi(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of one set."""
    start = sigma((shingles >> np.uint64(32)).astype(np.uint32))
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(start), BLOCK):
        np.minimum(out, pi(start[None, i : i + BLOCK] + shifts).min(axis=1), out=out)
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    x = coordinates.astype(np.uint64).reshape(bands, rows)
    return mix((x * _ODD[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _ODD[63])


def describe(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, f1, f2, bands`` of every text; f1 and f2 identify the set."""

    def task(batches):
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch):
                n, f1, f2, keys = [], [], [], []
                for s in shingle_sets(part.column("text"), size, hasher):
                    n.append(len(s))
                    f1.append(mix(s ^ _ODD[7]).sum(dtype=np.uint64))
                    f2.append(mix(s ^ _ODD[8]).sum(dtype=np.uint64))
                    keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else np.zeros(bands, np.uint64))
                flat = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(np.array(f1, np.uint64).view(np.int64)),
                        pa.array(np.array(f2, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), pa.array(flat)),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"
    )


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, shingles`` with the whole set of every text."""

    def task(batches):
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column("text"), size, hasher))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "shingles"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity."""
    both = salted_join(pairs, sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a", "b")
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - common
    return both.where(100 * common >= percent * union).select("a", "b").distinct()


def compare(group: pa.Table, percent: int) -> pa.Table:
    """Links that join components of a part of a bucket: its leaders against all its rows."""
    ids, component = np.asarray(group["doc_id"]), np.asarray(group["component"]).copy()
    sets = group["shingles"].combine_chunks()
    size = np.asarray(sets.value_lengths()).astype(np.int64)
    _, codes = np.unique(np.asarray(sets.flatten()), return_inverse=True)
    begin = np.cumsum(size) - size
    mark = np.zeros(int(codes.max()) + 1, np.int64)
    a, b = [], []
    for i in np.flatnonzero(np.asarray(group["leader"])).tolist():
        if (component == component[i]).all():
            continue
        own = codes[begin[i] : begin[i] + size[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[codes], begin)
        mark[own] = 0
        linked = np.flatnonzero((100 * common >= percent * (size + size[i] - common)) & (component != component[i]))
        for j in linked.tolist():
            if component[j] != component[i]:
                a.append(min(ids[i], ids[j])), b.append(max(ids[i], ids[j]))
                component[component == component[j]] = component[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def compare_leaders(open_: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """One round over buckets with several components: ``(links, leaders)``.

    ``open_ (band, doc_id, component, n_shingles, parts)``. Leaders are members of a bucket's
    smaller components first; they are compared with every member of the bucket, which
    is dealt out in parts of ``PART_BYTES`` of sets with the leaders added to each.
    """
    sizes = open_.groupBy("band", "component").agg(F.count("*").alias("mates"))
    order = Window.partitionBy("band").orderBy("mates", F.xxhash64("doc_id"), "doc_id")
    first = (
        open_.join(sizes, ["band", "component"])
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= LEADERS)
        .withColumn("sum", F.sum("n_shingles").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("place") == 1) | (8 * F.col("sum") <= PART_BYTES // 2))
        .select("band", "doc_id", "component", "parts")
    )
    leaders = written(first, "neardup-leaders")
    members = open_.join(leaders.select("band", "doc_id"), ["band", "doc_id"], "left_anti")
    dealt = members.select("band", "doc_id", "component", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"), F.lit(False).alias("leader"))
    every = leaders.select(
        "band", "doc_id", "component", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("parts") - 1).cast("long"))).alias("part"), F.lit(True).alias("leader")
    )
    rows = dealt.unionByName(every).join(sets, "doc_id")
    return rows.groupBy("band", "part").applyInArrow(lambda t: compare(t, percent), "a long, b long").distinct(), leaders


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per text: ``doc_id, n_shingles, component_id, kept``.

    ``docs`` needs ``doc_id`` and ``text``. A component is named by its smallest id;
    ``kept`` marks that text.
    """
    rows = written(describe(docs, size), "neardup-rows")
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = written(
        named.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select(
            "f1", "f2", "n_shingles", F.col("m.doc_id").alias("doc_id"), F.col("m.bands").alias("bands")
        ),
        "neardup-classes",
    )
    members = classes.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min(F.struct("doc_id", "n_shingles")).alias("first"), F.count("*").alias("n"))
    rest = members.join(shared.where(F.col("n") > 1).select("band", "first"), "band").where(F.col("doc_id") != F.col("first.doc_id"))
    buckets = written(rest.select("band", "doc_id", "n_shingles", "first"), "neardup-buckets")
    ids = buckets.select("doc_id").union(buckets.select("first.doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    sets = written(full_sets(texts, size), "neardup-sets")
    near = 100 * F.least("n_shingles", "first.n_shingles") >= percent * F.greatest("n_shingles", "first.n_shingles")
    pairs = written(buckets.where(near).select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "neardup-pairs")
    links = written(confirm(pairs, sets, percent), "neardup-links")
    pool = buckets.select("band", "doc_id", "n_shingles")
    while True:
        labels = components(links)
        known = labels.select(F.col("id").alias("doc_id"), "component")
        pool = pool.drop("component", "parts").join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        several = (
            pool.groupBy("band")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("doc_id") % (1 << 52)).alias("h"), F.min("doc_id").alias("f"), F.ceil(8 * F.sum("n_shingles") / PART_BYTES).cast("int").alias("parts"))
            .where("lo < hi")
        )
        once = several.groupBy("n", "h", "f").agg(F.min(F.struct("band", "parts")).alias("b")).select("b.*")  # equal buckets of several bands
        pool = written(pool.join(once, "band"), "neardup-open")
        if pool.isEmpty():
            break
        found, leaders = compare_leaders(pool, sets, percent)
        links = links.unionByName(written(found, "neardup-links"))
        pool = pool.join(leaders.select("band", "doc_id"), ["band", "doc_id"], "left_anti")
    own_class = classes.join(known, "doc_id", "left").select(
        "f1", "f2", "n_shingles", F.coalesce("component", "doc_id").alias("component")
    )
    joined = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    own = F.when(joined, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return rows.join(own_class, ["f1", "f2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
    )
