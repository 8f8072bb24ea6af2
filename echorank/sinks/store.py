"""A feature store: tables bucketed and sorted by id, joined without a shuffle.

Features come in once and are joined for every ranking. Dealt into the same number of
buckets by id when they are written, all tables of the store meet bucket by bucket: the
join of six tables has no exchange, and one task reads the same bucket of each. The one
shuffle is paid at the write, per table and only for new rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import try_parquet

# Bytes that a bucket of one table should hold, by Catalyst's estimate of the rows.
BUCKET_BYTES = 128 << 20
# Fixed value: the most buckets that Spark takes.
MAX_BUCKETS = 100_000
# Fixed value: how the number of buckets is written in the name of a table's folder.
_FOLDER = "{name}.buckets-{n}"


def bucket_count(tables: Mapping[str, DataFrame], least: int = 1) -> int:
    """Buckets for a store: the largest table over ``BUCKET_BYTES``, at least one per core.

    Too few buckets cannot be split later without writing the store again, so this
    should be asked with the size that the tables are to reach. Where Catalyst has no
    usable estimate (rows made in memory), that is an error.
    """
    spark = next(iter(tables.values())).sparkSession
    sizes = [int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables.values()]
    n = max(least, spark.sparkContext.defaultParallelism, -(-max(sizes) // BUCKET_BYTES))
    if n > MAX_BUCKETS:
        raise ValueError(f"{max(sizes)} bytes estimated, {n} buckets: choose their number")
    return n


def _table(prefix: str, name: str) -> str:
    if not re.fullmatch(r"\w+", prefix) or not re.fullmatch(r"\w+", name):
        raise ValueError(f"no plain name: {prefix}, {name}")
    return f"{prefix}_{name}"


def write_store(tables: Mapping[str, DataFrame], path: str, prefix: str, buckets: int, append: bool = False) -> None:
    """Write ``{name: table}`` with an ``id`` each below ``path``, as tables ``<prefix>_<name>``.

    Every task writes whole buckets: rows are dealt by id into as many tasks as buckets,
    so a bucket is one file per write. Ids may repeat; rows without an id go to one bucket.
    ``append`` adds files to the buckets of a store that ``open_store`` has opened.
    """
    for name, df in tables.items():
        writer = df.repartition(buckets, "id").write.mode("append" if append else "error").format("parquet")
        writer = writer.bucketBy(buckets, "id").sortBy("id")
        writer.option("path", f"{path.rstrip('/')}/{_FOLDER.format(name=name, n=buckets)}").saveAsTable(_table(prefix, name))


def open_store(spark: SparkSession, path: str, prefix: str, names: Sequence[str], buckets: int) -> dict[str, DataFrame]:
    """The tables of a store, registered in this session's catalogue if they are not yet."""
    out = {}
    for name in names:
        table = _table(prefix, name)
        if not spark.catalog.tableExists(table):
            folder = f"{path.rstrip('/')}/{_FOLDER.format(name=name, n=buckets)}"
            held = try_parquet(spark, folder)
            if held is None:
                raise ValueError(f"no {name} of {buckets} buckets in {path}")
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
            spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{folder}'"
            )
        out[name] = spark.table(table)
    return out


def close_store(spark: SparkSession, prefix: str, names: Sequence[str]) -> None:
    """Take the tables out of the catalogue; the files stay."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {_table(prefix, name)}")


def assemble_store(tables: Mapping[str, DataFrame], how: str = "inner") -> DataFrame:
    """One wide table by id: a merge of sorted buckets, without an exchange of any table.

    Whole-row copies multiply, as in ``assemble_features(dedupe=False)``. The hint keeps
    Spark from sending a small table to all tasks in place of its buckets.
    """
    return reduce(lambda a, b: a.join(b.hint("merge"), "id", how), tables.values())

