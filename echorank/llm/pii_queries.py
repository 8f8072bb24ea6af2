"""Registered query of the personal-data operator."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from echorank.llm.pii import mapped_spans, train
from echorank.llm.registry import query
from echorank.llm.semicrf import KINDS
from echorank.llm.tables import table


def digests(text, base, spans) -> tuple:
    """Counts of the base spans by kind, their digest, and all spans as a string."""
    joined = [",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in (base, spans)]
    return *(sum(k == kind for k, _, _ in base) for kind in KINDS), hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]


@query("op5_semi_markov_pii")
def op5_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return mapped_spans(docs, train(docs), ["doc_id"], fields, [pa.int64()] * 4 + [pa.string()] * 2, digests)
