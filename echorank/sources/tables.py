"""CSV, Parquet and ARFF feature sets."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.fileorder import check_file_order
from ..operators.integrity import check_duplicates, check_id_consistency

IDS = "id"


def split_fields(line: Column, sep: str = ",") -> Column:
    """The fields of a CSV line; a field in double quotes keeps its separators."""
    mark = re.escape(sep)
    # With a separator before the first field too, no match is empty, so none is skipped.
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{mark}(?:"[^"]*(?:""[^"]*)*"|[^{mark}]*)'), F.lit(0))
    bare = F.transform(quoted, lambda f: F.substring(f, len(sep) + 1, 1 << 30))
    unquoted = F.transform(
        bare,
        lambda f: F.when(f.startswith('"'), F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f),
    )
    return F.when(line.contains('"'), unquoted).otherwise(F.split(line, mark))


def read_features_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    id_column: int | Sequence[int] = 0,
    sep: str = ",",
    separate_ids: bool = True,
    ids_only: bool = False,
    name: str = "vec",
    ragged: str = "fail",
) -> DataFrame:
    """Header-less CSV of ids and numbers; ids may be quoted, but hold no line break.

    ``id_column`` is a position, negative from the end, or a list of them: the
    first becomes ``id``, the others ``id2``, ``id3`` …. Without ``separate_ids``
    every field comes back as it is, in an array of strings. An empty field is NULL.

    Every line is cut for itself, so no value is lost or made up. A line of another
    width than the first fails the job that reads it; with ``ragged="keep"`` its
    vector is as long as the line has it, to be set aside by its size.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = split_fields(F.col("value"), sep)
    if ragged == "fail":
        first = lines.select(F.size(fields)).first()
        width = first[0] if first else 0
        message = F.concat(F.lit(f"a line of the features has not {width} fields but "), F.size("_f").cast("string"))
        rows = lines.select(fields.alias("_f")).select(
            F.when(F.size("_f") == width, F.col("_f")).otherwise(F.raise_error(message).cast("array<string>")).alias("_f")
        )
    elif ragged == "keep":
        rows = lines.select(fields.alias("_f"))
    else:
        raise ValueError("ragged is 'fail' or 'keep'")
    rows = rows.select(F.transform("_f", lambda f: F.nullif(f, F.lit(""))).alias("_f"))
    if not separate_ids and not ids_only:
        return rows.select(F.col("_f").alias(name))
    at = [id_column] if isinstance(id_column, int) else list(id_column)
    ids = [F.try_element_at("_f", F.lit(p + 1 if p >= 0 else p)).alias(IDS if n == 0 else f"{IDS}{n + 1}") for n, p in enumerate(at)]
    if ids_only:
        return rows.select(*ids)
    places = [F.lit(p) if p >= 0 else F.size("_f") + p for p in at]
    values = F.filter("_f", lambda f, n: ~n.isin(*places))
    return rows.select(*ids, F.transform(values, lambda f: f.cast("double")).alias(name))


def read_feature_set(
    spark: SparkSession,
    stub: str,
    types: str | Sequence[str] = ("rh", "ssd", "rp"),
    id_column: int | Sequence[int] = 0,
    error_on_duplicates: bool = True,
    check: bool = True,
    check_order: bool = False,
) -> dict[str, DataFrame]:
    """``{type: table}`` of the files ``stub.<type>``.

    With ``check`` the types must hold the same ids, each once. Duplicates are
    an error or a warning. With ``check_order`` the ids must also stand in the same
    order, line by line.
    """
    types = [types] if isinstance(types, str) else list(types)
    tables = {t: read_features_csv(spark, f"{stub}.{t}", id_column, name=t) for t in types}
    if check:
        check_id_consistency(tables)
        check_duplicates(tables[types[0]], raise_error=error_on_duplicates)
    if check_order:
        first = id_column if isinstance(id_column, int) else id_column[0]
        check_file_order(spark, {t: f"{stub}.{t}" for t in types}, first)
    return tables


def read_features_multi(
    spark: SparkSession, stubs: str | Sequence[str], types: Sequence[str], common_path: str = ""
) -> dict[str, DataFrame]:
    """Several feature sets, appended row-wise per type."""
    stubs = [stubs] if isinstance(stubs, str) else list(stubs)
    prefix = f"{common_path.rstrip('/')}/" if common_path else ""
    sets = [read_feature_set(spark, prefix + stub, types) for stub in stubs]
    return {t: reduce(DataFrame.unionByName, [s[t] for s in sets]) for t in sets[0]}


def try_parquet(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None if there is none."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def load_features(spark: SparkSession, stub: str, types: str | Sequence[str]) -> dict[str, DataFrame]:
    """Parquet tables ``stub.<type>.parquet`` if they are there, else CSV."""
    types = [types] if isinstance(types, str) else list(types)
    stored = {t: try_parquet(spark, f"{stub}.{t}.parquet") for t in types}
    if all(df is not None for df in stored.values()):
        check_id_consistency(stored)
        return stored
    found = [t for t, df in stored.items() if df is not None]
    if found:
        warnings.warn(f"only {found} stored as Parquet, reading CSV")
    return read_feature_set(spark, stub, types, error_on_duplicates=False)


_ATTRIBUTE = re.compile(r"""^@attribute\s+('(?:[^']*)'|"(?:[^"]*)"|\S+)\s+(.+)$""", re.IGNORECASE)


def read_arff(spark: SparkSession, path: str, header_lines: int = 100_000) -> DataFrame:
    """``(vec, class)`` of an ARFF file: the last attribute is the class.

    Only ``@`` lines go to the driver, and only up to the bound; an ``ID``
    attribute comes back as ``id``. Quoted values keep their commas.
    """
    lines = spark.read.text(path)
    text = F.trim("value")
    header = [r.value for r in lines.where(text.rlike("(?i)^@attribute")).limit(header_lines + 1).collect()]
    if len(header) > header_lines:
        raise ValueError(f"more than {header_lines} attributes")
    names = [_ATTRIBUTE.match(line.strip()).group(1).strip("'\"") for line in header]
    if not names:
        raise ValueError(f"no attributes in {path}")
    schema = ", ".join(f"_{n} string" for n in range(len(names)))
    body = lines.where((text != "") & ~text.startswith("@") & ~text.startswith("%"))
    row = body.select(F.from_csv("value", schema, {"quote": '"', "escape": '"'}).alias("r"))
    numeric = [n for n, name in enumerate(names[:-1]) if name != "ID"]
    ids = [F.col(f"r._{n}").alias("id") for n, name in enumerate(names[:-1]) if name == "ID"]
    vec = F.array(*[F.trim(f"r._{n}").cast("double") for n in numeric]).alias("vec")
    return row.select(*ids, vec, F.trim(f"r._{len(names) - 1}").alias("class"))


def read_csv_encoded(
    spark: SparkSession, path: str, encoding: str = "utf-8", max_field_size: int | None = None, header: bool = False
) -> DataFrame:
    """CSV in a given encoding; ``header`` names the columns.

    A field above ``max_field_size`` fails the read with its length, when the
    field is used. UTF-16 text cannot be split at line breaks by bytes, so each such
    file is read by one task.
    """
    df = spark.read.csv(path, encoding=encoding, header=header, quote='"', escape='"', multiLine=encoding.lower().startswith("utf-16"))
    if max_field_size is None:
        return df

    def limited(name: str):
        message = F.concat(F.lit(f"a field has more than {max_field_size} characters: "), F.length(name).cast("string"))
        return F.when(F.length(name) > max_field_size, F.raise_error(message).cast("string")).otherwise(F.col(name))

    return df.select(*[limited(f"`{c}`").alias(c) for c in df.columns])
