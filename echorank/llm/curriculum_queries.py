"""The registered query of the source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echorank.llm.curriculum import integral, mix
from echorank.llm.registry import query
from echorank.llm.tables import table

WORD = r"[^\x20\x09-\x0D]+"
BUDGET, MAX_EPOCHS, SALT = 1.5, 2, "mix:"
#: Weights that integrate to 5, 2 and 1: falling, held in the middle, rising.
SCHEDULES = [
    [(0.0, 7.0), (1.0, 3.0)],
    [(0.0, 1.0), (0.5, 3.0), (1.0, 1.0)],
    [(0.0, 0.5), (1.0, 1.5)],
]



def _inverse_sql(schedule) -> str:
    """``curriculum.inverse`` as SQL over ``share``."""
    whole, before, cases = integral(schedule), 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area, slope = (t1 - t0) * (w0 + w1) / 2.0, (w1 - w0) / (t1 - t0)
        need = f"least({area}::DOUBLE, greatest(0.0::DOUBLE, share * {whole}::DOUBLE - {before}::DOUBLE))"
        root = f"({w0}::DOUBLE + sqrt({w0 * w0}::DOUBLE + {2 * slope}::DOUBLE * {need}))"
        cases.append(f"WHEN share * {whole}::DOUBLE <= {before + area}::DOUBLE THEN {t0}::DOUBLE + 2.0::DOUBLE * {need} / {root}")
        before += area
    return f"CASE {' '.join(cases)} ELSE 1.0::DOUBLE END"


INVERSE_SQL = "CASE kind " + " ".join(f"WHEN {i} THEN {_inverse_sql(s)}" for i, s in enumerate(SCHEDULES)) + " END"

OP11_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER + 1] AS weight,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
  FROM doc GROUP BY source
), fill AS (
  SELECT 0 AS round, -1.0::DOUBLE AS level, -1::BIGINT AS stopped
  UNION ALL
  SELECT round + 1, ({BUDGET} * (SELECT sum(source_size) FROM src)::DOUBLE - fixed) / open_weight, n
  FROM (
    SELECT round, any_value(stopped) AS stopped, count(*) FILTER (WHERE stops) AS n,
           coalesce(sum({MAX_EPOCHS} * source_size) FILTER (WHERE stops), 0)::DOUBLE AS fixed,
           sum(weight) FILTER (WHERE NOT stops) AS open_weight
    FROM (SELECT fill.round, fill.stopped, src.*, {MAX_EPOCHS} * source_size <= level * weight AS stops FROM fill, src)
    GROUP BY round
  ) WHERE n > stopped AND open_weight > 0
), target AS (
  SELECT source, kind, source_size,
         least(({MAX_EPOCHS} * source_size)::DOUBLE, (SELECT greatest(level, 0.0) FROM fill ORDER BY round DESC LIMIT 1) * weight) AS target
  FROM src
), parted AS (
  SELECT doc_id, size, source_size, target, kind, round(target)::BIGINT AS finish,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('{SALT}' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM doc JOIN target USING (source)
  WHERE source IS NOT NULL
  UNION ALL
  SELECT doc_id, size, source_size, target, kind, round(target)::BIGINT,
         coalesce(sum(size) OVER (ORDER BY md5('{SALT}' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
  FROM doc JOIN target ON doc.source IS NULL AND target.source IS NULL
), stream AS (
  SELECT *, row_number() OVER () AS row_id FROM parted
), copies AS (
  SELECT *, {INVERSE_SQL} AS moment
  FROM (SELECT *, start + copy * source_size AS first, greatest(0, least(size, finish - start - copy * source_size)) AS words,
               (start + copy * source_size)::DOUBLE / target AS share
        FROM stream, range({MAX_EPOCHS}) AS r(copy))
  WHERE words > 0
), trained AS (
  SELECT row_id, copy, moment, words, sum(words) OVER (ORDER BY moment, doc_id NULLS FIRST, copy, size ROWS UNBOUNDED PRECEDING) - words AS position FROM copies
)
SELECT doc_id, size, source_size, target, coalesce(t.taken, 0)::BIGINT AS taken, coalesce(t.copies, 0)::BIGINT AS copies, first_at, first_position::BIGINT AS first_position
FROM stream LEFT JOIN (
  SELECT row_id, sum(words) AS taken, count(*) AS copies, min(moment) AS first_at, min(position) AS first_position FROM trained GROUP BY row_id) AS t USING (row_id)
"""


@query("op11_curriculum_mix", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    copies = mix(docs, "doc_id", "source", F.regexp_count("text", F.lit(WORD)), SCHEDULES, BUDGET, MAX_EPOCHS, SALT)
    facts = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return (
        copies.groupBy("document")
        .agg(*facts, F.sum("taken").alias("taken"), F.count("copy").alias("copies"), F.min("at").alias("first_at"), F.min("position").alias("first_position"))
        .drop("document")
    )
