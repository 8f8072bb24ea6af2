"""Reading the given tables and cutting lineage by written tables."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

from echorank.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read again.

    The written table survives lost executors and cuts the lineage; later readers
    prune its columns.
    """
    path = scratch_path(df.sparkSession, f"llm-{label}")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def send(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast of ``value`` with the classes of its parts, for workers without this package.

    Spark pickles what it broadcasts by reference to modules; only closures go by value.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> Any:
    """What ``send`` was given, inside a task."""
    return pickle.loads(sent.value)


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
