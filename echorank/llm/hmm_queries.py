"""Registered query of the language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echorank.llm.hmm import score_texts
from echorank.llm.registry import query
from echorank.llm.tables import table
from echorank.llm.toxicity import fold

FOLDS, HELD_OUT = 5, 1


@query("op1_hidden_markov_lm")
def op1_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.select("doc_id", "text", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")))
