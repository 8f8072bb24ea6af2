"""Registered query of the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echorank.llm.neardup import near_duplicates
from echorank.llm.registry import query
from echorank.llm.tables import table


@query("op8_circulant_minhash")
def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)
