"""Extendible hashing: shards addressed by hash-prefix bits, split only where too large.

A bucket is a prefix of a row's 60-bit hash. It splits on one more bit while it
holds more than ``limit`` bytes; the others keep their depth. The directory (one
row per bucket) is an aggregate: bytes per fine prefix are summed once, the sums of
all shorter prefixes follow from it, and only rows below buckets that are still too
large are counted again with more bits. No row is held in a task or on the driver.

Defined results: a NULL in the key or the payload counts as an empty string; a
bucket of one row is never split, even if the row alone exceeds the limit; rows that
share all 60 bits (repeated rows) overflow into numbered pages of at most ``limit``
bytes each; an empty table gives an empty assignment. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echorank.llm.tables import written

HASH_BITS = 60
# Fine prefixes counted in one pass beyond those that an even split would need.
SPARE_BITS = 6
# Buckets up to this depth are broadcast: fewer than 2 ** (SHALLOW + 1) rows of four numbers.
SHALLOW = 11


def hash60(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of the parts, joined by a unit separator."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: Column) -> Column:
    """The ``depth`` leading bits of a hash as a number."""
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - depth).cast("int"))


def _level(cells: DataFrame, bits: int, start: int, limit: int, deepest: bool) -> DataFrame:
    """Per fine cell the depth of its bucket, or NULL where ``bits`` are not enough."""
    depths = F.explode(F.sequence(F.lit(start), F.lit(bits))).alias("depth")
    every = cells.select("cell", "bytes", "n", depths).withColumn(
        "bucket", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("depth")).cast("int"))
    )
    sums = every.groupBy("depth", "bucket").agg(F.sum("bytes").alias("b"), F.sum("n").alias("rows"))
    fits = (F.col("b") <= limit) | (F.col("rows") <= 1)
    if deepest:
        fits = fits | (F.col("depth") == bits)
    leaves = sums.where(fits).select("depth", "bucket", F.col("b").alias("bucket_bytes"), F.col("rows").alias("bucket_rows"))
    # A shallow bucket has many cells, but there are few such buckets: they go to all tasks.
    # A deeper one has its share of the cells, by the hash.
    places, shallow = every.select("cell", "depth", "bucket"), F.col("depth") <= SHALLOW
    met = places.where(shallow).join(F.broadcast(leaves.where(shallow)), ["depth", "bucket"])
    met = met.unionByName(places.where(~shallow).join(leaves.where(~shallow), ["depth", "bucket"]))
    return (
        met.groupBy("cell")
        .agg(F.min(F.struct("depth", "bucket", "bucket_bytes", "bucket_rows")).alias("leaf"))
        .select("cell", "leaf.*")
    )


def assign_shards(docs: DataFrame, key: str, payload: str, limit: int) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``bytes``, ``shard``, ``depth``, ``page``.

    ``shard`` is the bucket's prefix in binary digits ('' when one shard holds all).
    """
    h = hash60(F.col(key), F.md5(F.coalesce(F.col(payload), F.lit(""))))
    slim = docs.select(
        F.col(key).alias("key"), h.alias("h"), F.octet_length(F.coalesce(F.col(payload), F.lit(""))).cast("long").alias("bytes")
    )
    rows = written(slim, "shard-rows")
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    even = max(1, -(-total // limit)).bit_length()
    placed, start, bits = None, 0, min(HASH_BITS, even + SPARE_BITS)
    while True:
        deepest = bits == HASH_BITS
        cells = (
            rows.withColumn("cell", prefix(F.col("h"), F.lit(bits)))
            .groupBy("cell")
            .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        )
        leaves = _level(cells, bits, start, limit, deepest)
        joined = written(
            rows.withColumn("cell", prefix(F.col("h"), F.lit(bits))).join(leaves, "cell", "left").drop("cell"),
            "shard-level",
        )
        done = joined.where(F.col("depth").isNotNull())
        placed = done if placed is None else placed.unionByName(done)
        rows = joined.where(F.col("depth").isNull()).select("key", "h", "bytes")
        if deepest or rows.isEmpty():
            break
        start, bits = bits + 1, min(HASH_BITS, bits + SPARE_BITS + 2)
    shard = F.when(F.col("depth") == 0, "").otherwise(
        F.lpad(F.conv(F.col("bucket").cast("string"), 10, 2), F.col("depth").cast("int"), F.lit("0"))
    )
    full = (F.col("bucket_bytes") > limit) & (F.col("bucket_rows") > 1)
    single = placed.where(~full).select("key", "bytes", shard.alias("shard"), "depth", F.lit(0).cast("long").alias("page"))
    # Rows equal in all bits are copies of each other: counted, then numbered again.
    copies = (
        placed.where(full)
        .groupBy("key", "bytes", shard.alias("shard"), "depth")
        .agg(F.count("*").alias("n"))
        .withColumn("per_page", F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long"))
        .withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("per_page")).cast("long") - 1)))
        .withColumn("left", F.least(F.col("per_page"), F.col("n") - F.col("page") * F.col("per_page")))
        .repartition("key", "shard", "page")
        .select("key", "bytes", "shard", "depth", "page", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))).alias("copy"))
        .drop("copy")
    )
    return single.unionByName(copies).withColumnRenamed("key", key)


def directory(assigned: DataFrame) -> DataFrame:
    """One row per shard page: ``shard``, ``depth``, ``page``, ``n_rows``, ``bytes``."""
    return assigned.groupBy("shard", "depth", "page").agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("bytes"))
