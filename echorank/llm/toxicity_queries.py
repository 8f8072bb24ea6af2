"""Registered query of the toxicity operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echorank.llm.registry import query
from echorank.llm.tables import table
from echorank.llm.toxicity import Classifier, fit, fold, with_score

#: Labels of one fold of four are never learned from; a score from here on is toxic.
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3


def classifier(spark: SparkSession, sf_dir: str) -> Classifier:
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    return fit(table(spark, sf_dir, "documents"), labels.select("doc_id", "toxic"))


@query("op10_kneser_ney_toxicity")
def op10_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_score(docs, classifier(spark, sf_dir), "score").select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
