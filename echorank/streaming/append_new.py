"""Append arriving items to a feature table, every new id exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sinks.text import append_new_only
from ..sources.lines import PARSERS


def append_new_stream(
    spark: SparkSession,
    incoming: str,
    table: str,
    checkpoint: str,
    ext: str | None = None,
    parse: Callable[[DataFrame], DataFrame] | None = None,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Read new feature files, parse them, and append the ids not yet stored.

    The checkpoint remembers the files already seen. A batch that is repeated
    after a failure finds its ids in the table, so nothing is written twice. Runs
    until all files at hand are done; start it again for later ones.
    """
    parse = parse or PARSERS[ext]
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(incoming)
    return (
        parse(lines)
        .writeStream.foreachBatch(lambda batch, _: append_new_only(batch, table))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
