"""From raw documents to token ids, one operator a stage.

``run`` applies the stages in order; each result is written as Parquet and read again
as the next stage's documents. All stages but the last return the columns of
``documents``. The stages' decisions:

1. toxicity: texts that score 0.3 or more are dropped; the classifier learns from the
   labels of the three folds that ``op10`` may use.
2. near_duplicates: of texts linked by shingles of five words with a similarity of 0.8
   or more, the one with the smallest id stays, of several with that id the first by the
   MD5 of its text. Unlike texts of one id both stay. Of rows equal in id and text one
   stays, texts without words included. Rows without an id stay.
3. decontamination: contaminated texts are dropped.
4. personal_data: spans are replaced by their kind, ``n_chars`` follows the text.
5. tokens: the columns of documents without the text, ``ids`` and ``n_tokens``; the ids
   have been decoded and compared with the text.

NULL texts pass all stages and have no tokens. Texts of any length are read whole. Extra
columns are kept up to the end. Empty tables give empty tables with the same columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echorank.llm import bpe, contamination, neardup, pii, toxicity
from echorank.llm.bpe_queries import VOCABULARY
from echorank.llm.tables import free_name, table, written
from echorank.llm.toxicity_queries import THRESHOLD, classifier

SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, classifier(spark, sf_dir), THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept rows. Rows are numbered and written once, so that rows of one id are told apart;
    only slim rows are joined and counted. The numbers of the dropped rows are written, so
    Spark knows their size: few enough go to all tasks, else the texts move once."""
    row, others = free_name(docs.columns, "row"), [c for c in docs.columns if c not in ("doc_id", "text")]
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows", "zstd")
    named = numbered.where(F.col("doc_id").isNotNull())
    found = neardup.near_duplicates(named.select(F.col(row).alias("doc_id"), "text"), SHINGLE, PERCENT)
    digest = F.md5(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")))
    rest = F.md5(F.to_json(F.struct(*others))) if others else F.lit("")
    slim = named.select(F.col(row).alias("n"), F.col("doc_id").alias("id"), digest.alias("digest"), rest.alias("rest"))
    slim = written(slim.join(found.select(F.col("doc_id").alias("n"), F.col("component_id").alias("component")), "n"), "pipeline-slim")
    first = slim.groupBy("component").agg(F.min(F.struct("id", "digest", "rest", "n")).alias("m")).select("m.*")
    once = first.groupBy("id", "digest").agg(F.min(F.struct("rest", "n")).alias("m")).select(F.col("m.n").alias(row))
    gone = written(slim.select(F.col("n").alias(row)).join(once, row, "left_anti"), "pipeline-gone")
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.redact(docs, pii.train(docs))
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.withColumn("n_chars", length) if "n_chars" in docs.columns else done


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, decoded again in the same task and compared with the text; a difference fails the job."""
    keep, path = [c for c in docs.columns if c != "text"], public_tokenizers.path(VOCABULARY)
    ids, n, own, back = (free_name(docs.columns, c) for c in ("ids", "n_tokens", "text_md5", "decoded_md5"))

    def round_trip(vocabulary, found):
        return found.astype(np.int32), hashlib.md5(vocabulary.decode(found).tobytes()).hexdigest()

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(back, T.StringType())]
    named = docs.withColumn(own, F.md5(F.coalesce("text", F.lit(""))))
    tokens = bpe.encode(named, path, public_tokenizers.PATTERN, [*keep, own], derive=(fields, round_trip))
    sound = F.when(F.col(own) == F.col(back), F.col(ids)).otherwise(F.raise_error(F.lit("token ids that do not decode to their text")))
    return tokens.select(*keep, sound.alias(ids)).withColumn(n, F.size(ids).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("tokens", encode),
]

#: No SQL: the classifier, the labelling of spans and the token merges are no queries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES, ORACLES = {"pipeline": run}, {}
