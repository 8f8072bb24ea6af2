"""Features of media files as they arrive.

The files are a binary stream: Spark lists them, opens them on whatever store it can read,
and the checkpoint is the list of those done. No listing is joined with stored ids, and no
task opens a path itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import class_label, file_id
from ..functions.rhythm import RhythmOptions
from ..plans.extraction import _ABOUT, feature_tables, file_features, spread
from ..session import SEGMENT_ROWS, arrow_rows, listing_session
from ..sources.media import AUDIO_SUFFIXES, below, local_name, suffix_glob

BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def media_stream(spark: SparkSession, source: str, suffixes: Sequence[str] | None = AUDIO_SUFFIXES, max_files_per_trigger: int = 1000) -> DataFrame:
    """A stream of ``(id, id2, content)``: ids relative to ``source``, ``id2`` the class of the file."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILES)
    reader = reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files_per_trigger)
    if suffixes is not None:
        reader = reader.option("pathGlobFilter", suffix_glob(suffixes))
    name = below(local_name(F.col("path")), source)
    return reader.load(source).select(file_id(name).alias("id"), class_label(name).alias("id2"), "content")


def extract_stream(
    spark: SparkSession,
    source: str,
    table: str,
    checkpoint: str,
    types: Sequence[str] = ("rp", "rh"),
    suffixes: Sequence[str] | None = AUDIO_SUFFIXES,
    options: RhythmOptions = RhythmOptions(),
    skip_leadin_fadeout: int = 1,
    step_width: int = 1,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Extract every file below ``source`` once, into a Parquet table parted by feature type.

    A file is a row in one batch: decoded, cut and aggregated in the task that has it. A
    broken one gives an error row, and is not tried again. A batch that fails leaves
    nothing in the table and is repeated. A file that changes later is not read again; a
    new name is a new file. Runs until all files at hand are done.
    """
    session = listing_session(spark, spread(spark))
    files = media_stream(session, source, suffixes, max_files_per_trigger)
    rows = file_features(files, types, options, skip_leadin_fadeout, step_width)
    with arrow_rows(session, SEGMENT_ROWS):
        return (
            rows.writeStream.format("parquet")
            .partitionBy("feature_type")
            .option("path", table)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def streamed_features(spark: SparkSession, table: str, types: Sequence[str] = ("rp", "rh"), label: bool = False) -> dict[str, DataFrame]:
    """``{type: table}`` of what ``extract_stream`` has written, and ``audit`` and ``errors``.

    A type is one folder: reading it touches no other.
    """
    rows = spark.read.parquet(table)
    good = rows.where(F.col("feature_type") == types[0])
    return {
        **feature_tables(rows, types, label),
        "audit": good.select("id", "sample_rate", *_ABOUT, "segments"),
        "errors": rows.where("error IS NOT NULL").select("id", "error"),
    }
