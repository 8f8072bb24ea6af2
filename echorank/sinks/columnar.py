"""Feature sets as Parquet tables ``stub.<type>.parquet``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import check_id_consistency, read_features_csv
from .text import write_features_csv


def write_columnar(
    tables: Mapping[str, DataFrame], stub: str, float32: bool = False, append: bool = False, rows_per_file: int = 0
) -> None:
    """``id[, id2], <type>`` per feature type; ``float32`` halves the size."""
    kind = "array<float>" if float32 else "array<double>"
    for name, df in tables.items():
        ids = [c for c in ("id", "id2") if c in df.columns]
        writer = df.select(*ids, F.col(name).cast(kind)).write.mode("append" if append else "overwrite")
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(f"{stub}.{name}.parquet")


def read_columnar(spark: SparkSession, stub: str, types: str | Sequence[str], ids_only: bool = False) -> dict[str, DataFrame]:
    """The tables of a stub; their ids must agree and no row may lack its vector."""
    types = [types] if isinstance(types, str) else list(types)
    tables = {t: spark.read.parquet(f"{stub}.{t}.parquet") for t in types}
    check_id_consistency(tables)
    for name, df in tables.items():
        lacking = df.where(F.col("id").isNull() | F.col(name).isNull()).limit(1).count()
        if lacking:
            raise ValueError(f"number of ids does not match number of {name} vectors")
    return {t: df.select("id") for t, df in tables.items()} if ids_only else tables


def csv_to_columnar(spark: SparkSession, csv_path: str, stub: str, name: str, id_column=0, float32: bool = False) -> None:
    write_columnar({name: read_features_csv(spark, csv_path, id_column, name=name)}, stub, float32)


def columnar_to_csv(spark: SparkSession, stub: str, out_stub: str, types: str | Sequence[str]) -> None:
    write_features_csv(read_columnar(spark, stub, types), out_stub)


def combine_columnar(spark: SparkSession, stubs: Sequence[str], out_stub: str, types: Sequence[str]) -> None:
    """Several Parquet feature sets as one."""
    sets = [read_columnar(spark, stub, types) for stub in stubs]
    write_columnar({t: reduce(DataFrame.unionByName, [s[t] for s in sets]) for t in types}, out_stub)
