"""A song catalogue derived from the given tables, in Spark and in SQL.

Vectors come from ``embeddings``, note sequences from whole ``documents`` (one
pitch per word), so the note table has items without vectors, or the other way
round, depending on the scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from echorank.functions.pitch import PITCHES
from echorank.operators.joins import assemble_features

SONG = "song7"
SONGS = ["song1", "song2", "song3", "song5", "song8", "song13", "song21", "song34"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("song"), F.col("vec_id")).alias("id"),
        "vec_id",
        "label",
        F.col("embedding").cast("array<double>").alias("e"),
    )


def notes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.transform(F.split("text", " "), lambda w: F.char(F.length(w) % 12 + 65))
    keys = F.array(*[F.lit(p) for p in PITCHES])
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("song"), F.col("doc_id")).alias("id"),
        F.get(keys, (F.col("doc_id") % 12).cast("int")).alias("key"),
        F.when(F.col("doc_id") % 2 == 0, "major").otherwise("minor").alias("scale"),
        F.array_join(letters, "").alias("notes"),
    )


def model_vector(e) -> F.Column:
    """A positive definite model with d = 2: means, then the 2x2 covariance."""
    return F.array(e[44], e[45], e[46] * e[46] + 1, e[47] / 10, e[47] / 10, e[48] * e[48] + 1)


def feature_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    base = vectors(spark, sf_dir)
    e = F.col("e")
    return {
        "rp": base.select("id", F.slice(e, 1, 24).alias("rp")),
        "rh": base.select("id", F.slice(e, 25, 12).alias("rh")),
        "bh": base.select("id", (F.col("vec_id") % 120 + 60).cast("double").alias("bpm"), F.slice(e, 37, 8).alias("bh")),
        "notes": notes_table(spark, sf_dir),
        "chroma": base.select("id", F.transform(F.slice(e, 41, 24), F.abs).alias("chroma")),
        "mfcc": base.select("id", model_vector(e).alias("mfcc")),
    }


def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features side by side. The vector features share one scan."""
    e = F.col("e")
    from_vectors = vectors(spark, sf_dir).select(
        "id",
        F.slice(e, 1, 24).alias("rp"),
        F.slice(e, 25, 12).alias("rh"),
        (F.col("vec_id") % 120 + 60).cast("double").alias("bpm"),
        F.slice(e, 37, 8).alias("bh"),
        F.transform(F.slice(e, 41, 24), F.abs).alias("chroma"),
        model_vector(e).alias("mfcc"),
    )
    return assemble_features([from_vectors, notes_table(spark, sf_dir)], dedupe=False)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- the same in SQL -------------------------------------------------------

_KEYS = ", ".join(f"'{p}'" for p in PITCHES)

TABLES_SQL = f"""
vec AS (
  SELECT 'song' || vec_id AS id, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
feat AS (
  SELECT id, e[1:24] AS rp, e[25:36] AS rh, CAST(vec_id % 120 + 60 AS DOUBLE) AS bpm, e[37:44] AS bh,
         list_transform(e[41:64], lambda v: abs(v)) AS chroma,
         e[45] AS m1, e[46] AS m2, 1 + e[47] * e[47] AS c11, e[48] / 10 AS c12, 1 + e[49] * e[49] AS c22
  FROM vec),
nts AS (
  SELECT 'song' || doc_id AS id, ([{_KEYS}])[doc_id % 12 + 1] AS key,
         CASE WHEN doc_id % 2 = 0 THEN 'major' ELSE 'minor' END AS scale,
         array_to_string(list_transform(string_split(text, ' '), lambda w: chr(CAST(65 + length(w) % 12 AS INTEGER))), '')
           AS notes
  FROM documents)"""


def _l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda k: ({a}[k] - {b}[k]) * ({a}[k] - {b}[k]))))"


def _chroma(q: str, x: str) -> str:
    first = f"list_sum(list_transform(range(0, 12), lambda r: {q}[2*r+1] * {x}[2*r+2]))"
    second = f"list_sum(list_transform(range(0, 12), lambda r: {q}[2*r+1] * {x}[2*r+1] + {q}[2*r+2] * {x}[2*r+2]))"
    return f"greatest(0, ({second} - {first}) / (1 + tan(pi() * 0.05)))"


DISTANCE_SQL = {
    "distances_rp": _l2("x.rp", "q.rp"),
    "distances_rh": _l2("x.rh", "q.rh"),
    "distances_bh": _l2("x.bh", "q.bh"),
    "distances_mfcc": "sqrt((x.m1-q.m1)^2 + (x.m2-q.m2)^2 + (x.c11-q.c11)^2 + (x.c12-q.c12)^2 + (x.c22-q.c22)^2)",
    "distances_corr": _chroma("q.chroma", "x.chroma"),
    "distances_skl": """((x.c11*q.c22 + x.c22*q.c11) / (q.c11*q.c22 - q.c12^2)
        + (q.c11*x.c22 + q.c22*x.c11) / (x.c11*x.c22 - x.c12^2)
        + (x.c22/(x.c11*x.c22 - x.c12^2) + q.c22/(q.c11*q.c22 - q.c12^2)) * (x.m1-q.m1)^2
        + (x.c11/(x.c11*x.c22 - x.c12^2) + q.c11/(q.c11*q.c22 - q.c12^2)) * (x.m2-q.m2)^2) / 4 - 1""",
}
_JS = """CASE WHEN ({a})*({d}) - ({b})*({c}) > 0
    THEN abs(ln(({a})*({d}) - ({b})*({c}))/2 - ln(x.c11*x.c22 - x.c12^2)/4 - ln(q.c11*q.c22 - q.c12^2)/4)
    ELSE CAST('inf' AS DOUBLE) END"""


def _mixed(c: str, m: str) -> str:
    return f"(x.{c}+x.{m}^2+q.{c}+q.{m}^2)/2 - ((x.{m}+q.{m})/2)^2"


DISTANCE_SQL["distances_js"] = _JS.format(
    a=_mixed("c11", "m1"), b=_mixed("c12", "m2"), c=_mixed("c12", "m1"), d=_mixed("c22", "m2")
)
DISTANCE_SQL["distances_levenshtein"] = "CAST(levenshtein(x.notes, q.notes) AS DOUBLE)"
