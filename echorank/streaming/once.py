"""Append every id once, with the ids in the stream's keyed state.

``append_new`` looks stored ids up in the table in every batch. Here they are the state of
the query, kept by RocksDB on the executors and versioned in the checkpoint: a batch reads
its own files and touches the keys it meets, however large the table has become.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.lines import PARSERS

# The state store that keeps keys on disk, and uploads only what changed.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings for the queries started inside; a running query keeps what it started with."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def append_once_stream(
    spark: SparkSession,
    incoming: str,
    table: str,
    checkpoint: str,
    ext: str | None = None,
    parse: Callable[[DataFrame], DataFrame] | None = None,
    max_files_per_trigger: int = 1000,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Read new feature files, parse them, and append the rows of ids never seen before.

    The table is the stream's own: Parquet files and the log of the finished batches, so a
    batch that fails half-way leaves nothing and is done again with the state before it.
    Ids that others have stored are not known to the stream. Rows without an id are left
    out. Of several rows with one id in one batch one is kept.

    ``state_partitions`` is fixed by the first start (by default the session's shuffle
    partitions): choose it for the number of ids expected over the years, some millions
    each. Runs until all files at hand are done; start it again for later ones.
    """
    parse = parse or PARSERS[ext]
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(incoming)
    fresh = parse(lines).where("id IS NOT NULL").dropDuplicates(["id"])
    chosen = STATE_STORE | ({"spark.sql.shuffle.partitions": str(state_partitions)} if state_partitions else {})
    with settings(spark, chosen):
        return (
            fresh.writeStream.format("parquet")
            .outputMode("append")
            .option("path", table)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
