"""Feature text files ``features<n>/out<n>.<ext>``: one item per line.

``parse_*`` work on any DataFrame with a ``value`` column, so batch and
streaming reads share them. A malformed number makes the vector NULL instead of
failing the job; ``split_malformed`` sets such rows aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import normalize_id, repair_delimiter
from ..functions.pitch import encode_pitches
from ..functions.vectors import matrix_order, parse_vector
from ..operators.filters import valid_chroma

# Where feature files lie, and numbers in a timbre model (13 + 13x13).
FEATURE_GLOB = "features[0-9]*/out[0-9]*"
MODEL_SIZE = 182


def read_feature_lines(spark: SparkSession, root: str, ext: str) -> DataFrame:
    """All lines of one feature family below ``root``."""
    return spark.read.text(f"{root.rstrip('/')}/{FEATURE_GLOB}.{ext}")


def _parts(df: DataFrame, line: Column, separator: str) -> DataFrame:
    return df.select(F.split(line, separator).alias("_p"))


def _vector_of(parts: Column) -> Column:
    return parse_vector(F.array_join(F.slice(parts, 2, F.size(parts)), ","))


def parse_vector_csv(lines: DataFrame, name: str) -> DataFrame:
    """``id,f1,…,fn`` without quoting; quoted ids are for ``csv.read_features_csv``."""
    p = F.col("_p")
    return _parts(lines, F.col("value"), ",").select(normalize_id(p[0]).alias("id"), _vector_of(p).alias(name))


def parse_vector_csv_bracketed(lines: DataFrame, name: str) -> DataFrame:
    """The same family with blanks, brackets or ``;`` in it: the media suffix ends the id."""
    line = repair_delimiter(F.translate("value", "[]", ""))
    p = F.col("_p")
    return _parts(lines, line, ";").select(normalize_id(p[0]).alias("id"), parse_vector(F.get(p, F.lit(1))).alias(name))


def parse_beat_histogram(lines: DataFrame) -> DataFrame:
    """``id; bpm; [v1,…]``."""
    p = F.col("_p")
    return _parts(lines, F.col("value"), ";").select(
        normalize_id(p[0]).alias("id"),
        F.trim(F.get(p, F.lit(1))).try_cast("double").alias("bpm"),
        parse_vector(F.get(p, F.lit(2))).alias("bh"),
    )


def parse_notes(lines: DataFrame) -> DataFrame:
    """``id; key; scale; [n1, …]`` with the pitches as letters."""
    p = F.col("_p")
    return _parts(lines, F.col("value"), ";").select(
        normalize_id(p[0]).alias("id"),
        F.trim(F.get(p, F.lit(1))).alias("key"),
        F.trim(F.get(p, F.lit(2))).alias("scale"),
        encode_pitches(F.get(p, F.lit(3))).alias("notes"),
    )


def parse_chroma(lines: DataFrame) -> DataFrame:
    """``id; [[12 rows of L values]]``; rows without usable numbers are dropped."""
    p = F.col("_p")
    return (
        _parts(lines, repair_delimiter("value"), ";")
        .where(valid_chroma(F.get(p, F.lit(1))))
        .select(normalize_id(p[0], strip_brackets=True).alias("id"), parse_vector(p[1]).alias("chroma"))
    )


def parse_mfcc_model(lines: DataFrame, size: int | None = MODEL_SIZE) -> DataFrame:
    """``id; [means]; [[covariance]]`` as one vector; NULL if it has another size."""
    p = F.col("_p")
    vec = parse_vector(F.get(p, F.lit(1)))
    d = matrix_order(F.col("mfcc"))
    fits = F.size("mfcc") == (F.lit(size) if size else d * (d + 1))
    return (
        _parts(lines, repair_delimiter("value"), ";")
        .select(normalize_id(p[0]).alias("id"), vec.alias("mfcc"))
        .withColumn("mfcc", F.when(fits, F.col("mfcc")))
    )


def parse_mfcc_statistics(lines: DataFrame) -> DataFrame:
    """``id; [means]; [variances]; [upper covariance triangle]``."""
    p = F.col("_p")
    return _parts(lines, F.col("value"), ";").select(
        normalize_id(p[0]).alias("id"),
        *[parse_vector(F.get(p, F.lit(n))).alias(c) for n, c in ((1, "mean"), (2, "var"), (3, "cov_ut"))],
    )


def parse_manifest(lines: DataFrame) -> DataFrame:
    """``id     :       part``."""
    pattern = r"^(.*\S)\s+:\s+(\d+)$"
    return lines.select(
        F.regexp_extract("value", pattern, 1).alias("id"),
        F.regexp_extract("value", pattern, 2).try_cast("int").alias("part"),
    )


def split_malformed(parsed: DataFrame, *required: str) -> tuple[DataFrame, DataFrame]:
    """``(good, malformed)`` by whether all required columns are there."""
    bad = F.lit(False)
    for column in required:
        bad = bad | F.col(column).isNull()
    return parsed.where(~bad), parsed.where(bad)


PARSERS = {
    "rp": lambda lines: parse_vector_csv(lines, "rp"),
    "rh": lambda lines: parse_vector_csv(lines, "rh"),
    "bh": parse_beat_histogram,
    "notes": parse_notes,
    "chroma": parse_chroma,
    "mfcckl": parse_mfcc_model,
    "mfcc": parse_mfcc_statistics,
    "files": parse_manifest,
}


def read_feature_files(spark: SparkSession, root: str, ext: str) -> DataFrame:
    """One feature family, parsed."""
    return PARSERS[ext](read_feature_lines(spark, root, ext))


def read_catalogue(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The six tables the rankings need, keyed by source."""
    tables = {ext: read_feature_files(spark, root, ext) for ext in ("rp", "rh", "bh", "notes", "chroma")}
    return tables | {"mfcc": read_feature_files(spark, root, "mfcckl")}


def read_file_list(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """One media path per line; relative ones get the prefix."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    name = F.trim("value")
    if prefix is None:
        return lines.select(name.alias("path"))
    absolute = F.when(name.startswith("/"), name).otherwise(F.concat_ws("/", F.lit(prefix.rstrip("/")), name))
    return lines.select(absolute.alias("path"))
