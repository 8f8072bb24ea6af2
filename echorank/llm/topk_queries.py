"""Registered query of the exact top-k search, with its SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echorank.llm.registry import query
from echorank.llm.tables import table
from echorank.llm.topk import search

K, SCALE, QUERY_EVERY = 5, 256, 50

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op2_norm_bucket_topk", OP2_SQL)
def op2_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = search(vectors, F.pmod(F.col("vec_id"), F.lit(QUERY_EVERY)) == 0, K, SCALE)
    fits = F.col("score").between(F.lit(Decimal(-(2**63))), F.lit(Decimal(2**63 - 1)))
    return found.withColumn("score", F.when(fits, F.col("score").cast("long")).otherwise(F.raise_error(F.lit("a score leaves 64 bits")).cast("long")))
