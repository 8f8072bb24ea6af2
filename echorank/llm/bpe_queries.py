"""Registered query of the byte-level BPE operator."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from echorank.llm.bpe import encode
from echorank.llm.registry import query
from echorank.llm.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

DIGESTS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def digests(vocabulary, ids) -> tuple[int, str, str]:
    """Number of ids, and the digests of the ids and of what they decode to."""
    packed = hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
    return len(ids), packed, hashlib.sha256(vocabulary.decode(ids).tobytes()).hexdigest()


@query("op6_matrix_bpe")
def op6_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ["doc_id"], derive=(DIGESTS, digests))
