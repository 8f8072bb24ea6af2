"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

# Rows per Arrow batch: wide feature rows, and waveform segments of 0.5 to 2 MB.
FEATURE_ROWS = 2048
SEGMENT_ROWS = 16


def build_session(app: str = "echorank", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is measured with.

    Feature rows are wide (a chroma matrix can hold thousands of doubles), so
    Arrow batches are bounded by rows. Everything else is left to AQE.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        ARROW_ROWS: str(FEATURE_ROWS),
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a session whose driver and executors are one process may fall back to a
    temporary folder of its own; a cluster, ``local-cluster`` too, has to name one.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="echorank-")
    spark.conf.set(CHECKPOINT_DIR, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/echorank/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what the library has written below the shared folder; results read from there go too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/echorank")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_small(df: DataFrame, max_bytes: int = 256 << 20) -> DataFrame:
    """Give a small table one partition per core before CPU-heavy scoring.

    A small table often lies in one file and would be scored by one task. The
    size is Catalyst's estimate; a larger table keeps the layout it has, which
    then has partitions enough, and is not shuffled.
    """
    if not hasattr(df, "_jdf"):  # a Connect session has no estimate
        return df
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimate)) > max_bytes:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bound Arrow batches for the jobs started inside; a lower bound stays."""
    before = spark.conf.get(ARROW_ROWS)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def listing_session(spark: SparkSession, tasks: int) -> SparkSession:
    """A session with the same settings that looks up named files in at most ``tasks`` tasks.

    Spark takes up to 10,000, one per file: each costs far more than its look-up. A stream
    reads that setting as it runs, so it cannot be set for a while only.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set(LISTING, str(min(int(spark.conf.get(LISTING)), tasks)))
    return session


def materialize(df: DataFrame, label: str, rows: int = FEATURE_ROWS) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where a result is read more than once (statistics, then scaling, then
    the sampling pass of a global sort). The written table survives the loss of
    executors, cuts the lineage and is column-pruned on every later read.
    ``rows`` bounds the Arrow batches of the Python stages in ``df``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with arrow_rows(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
