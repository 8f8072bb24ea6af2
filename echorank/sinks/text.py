"""CSV, feature lines, ARFF, manifests and audit tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import class_label
from ..functions.vectors import format_matrix, format_vector, to_feature_frame
from ..operators.joins import anti_existing
from ..operators.ordering import with_position
from ..sources.tables import read_feature_set, read_features_multi, try_parquet


def write_ranking_csv(ranking: DataFrame, path: str, score: str = "aggregated", with_index: bool = True) -> None:
    """A ranking as CSV with header, the position first if asked.

    List columns are written as ``[a,b]``.
    """
    df = with_position(ranking, score) if with_index else ranking
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    df = df.withColumns({c: format_vector(c, None) for c in lists}) if lists else df
    if with_index:
        df = df.select("position", *[c for c in df.columns if c != "position"]).orderBy("position")
    df.write.mode("overwrite").csv(path, header=True)


def _quoted(column: str) -> Column:
    """A CSV field, quoted if it holds a separator or a quote.

    An id with a line break fails the write: files are read line by line.
    """
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    broken = F.raise_error(F.concat(F.lit(f"a line break in {column}: "), value)).cast("string")
    return F.when(value.rlike(r"[\r\n]"), broken).when(value.rlike('[,"]'), quoted).otherwise(value)


def feature_row(df: DataFrame, vec: str) -> Column:
    """``id[,id2],value…`` as one text column: no column per dimension to generate code for."""
    ids = [_quoted(c) for c in ("id", "id2") if c in df.columns]
    return F.concat_ws(",", *ids, F.array_join(F.col(vec).cast("array<string>"), ",", ""))


def vector_dim(df: DataFrame, vec: str) -> int:
    """The one length of all vectors, 0 without any; an error if there are several."""
    low, high = df.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if low is None:
        return 0
    if low != high:
        raise ValueError(f"{vec} has no single dimension: {low} to {high}")
    return low


def write_features_csv(
    tables: Mapping[str, DataFrame], stub: str, append: bool = False, dims: Mapping[str, int] | None = None
) -> None:
    """One header-less CSV per feature type: ``stub.<type>``.

    Vectors of one type must have one length: that is checked, unless it is given
    in ``dims``.
    """
    for name, df in tables.items():
        if name not in (dims or {}):
            vector_dim(df, name)
        lines = df.select(feature_row(df, name).alias("value"))
        lines.write.mode("append" if append else "overwrite").text(f"{stub}.{name}")


def feature_line(ext: str, decimals: int | None = 8) -> Column:
    """The text line of one feature family, from the columns its parser yields.

    ``mfcckl`` wants ``mean`` and ``cov``, ``chroma`` a 12-row matrix, ``notes``
    an array of pitches.
    """
    fields = {
        "rp": lambda: None,
        "rh": lambda: None,
        "bh": lambda: [F.col("bpm").cast("string"), format_vector("bh", decimals)],
        "notes": lambda: [F.col("key"), F.col("scale"), _pitches("pitches")],
        "chroma": lambda: [format_matrix("chroma", 12, decimals)],
        "mfcckl": lambda: [format_vector("mean", decimals), format_matrix("cov", F.size("mean"), decimals)],
        "mfcc": lambda: [format_vector(c, decimals) for c in ("mean", "var", "cov_ut")],
    }[ext]()
    if fields is None:
        return F.concat_ws(",", F.col("id"), F.translate(format_vector(ext, decimals), "[]", ""))
    return F.concat_ws("; ", F.col("id"), *fields)


def _pitches(column: str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.col(column).cast("array<string>"), ", "), F.lit("]"))


def write_feature_lines(df: DataFrame, path: str, ext: str, decimals: int | None = 8, mode: str = "overwrite") -> None:
    df.select(feature_line(ext, decimals).alias("value")).write.mode(mode).text(path)


# Characters that an ARFF value is quoted for; an empty one is too.
_ARFF_SPECIAL = r"""[,\s"'{}%]|^$"""


def _arff_value(column: str, numeric: bool) -> Column:
    value = F.col(column).cast("string")
    if numeric:
        return F.coalesce(value, F.lit("?"))
    return F.coalesce(
        F.when(value.rlike(_ARFF_SPECIAL), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value),
        F.lit("?"),
    )


def _arff_name(name: str) -> str:
    """A class name as ``_arff_value`` writes it in the rows."""
    return '"' + name.replace('"', '""') + '"' if re.search(_ARFF_SPECIAL, name) else name


def write_arff(df: DataFrame, path: str, relation: str, max_classes: int = 100_000) -> None:
    """A flat frame (``to_feature_frame``) as one ARFF folder.

    Only the class names come to the driver, up to a bound; the rows are written
    by the executors, below the header, which is a part file of its own.
    """
    spark = df.sparkSession
    lines = [f"@Relation {relation}"]
    for name in df.columns:
        if name == "ID":
            kind = "string"
        elif name == "class":
            classes = [r[0] for r in df.select("class").distinct().orderBy("class").limit(max_classes + 1).collect()]
            if len(classes) > max_classes:
                raise ValueError(f"more than {max_classes} classes")
            kind = "{" + ",".join(_arff_name(str(c)) for c in classes if c is not None) + "}"
        else:
            kind = "numeric"
        lines.append(f"@Attribute {name} {kind}")
    lines += ["", "@Data"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    body = F.concat_ws(",", *[_arff_value(c, c not in ("ID", "class")) for c in df.columns])
    df.select(body.alias("value")).write.mode("append").text(path)


def csv_to_arff(
    spark: SparkSession, stub: str, out_stub: str, types: str | Sequence[str], add_class: bool = True, dims=None
) -> None:
    """CSV feature set → ARFF per type; the class is the id up to the first dot."""
    for name, df in read_feature_set(spark, stub, types).items():
        if add_class:
            df = df.withColumn("class", class_label("id", "prefix"))
        dim = (dims or {}).get(name) or vector_dim(df, name)
        frame = to_feature_frame(df, name, dim, class_col="class" if add_class else None)
        write_arff(frame, f"{out_stub}.{name}.arff", relation=f"{out_stub}.{name}.arff")


def concat_feature_files(spark: SparkSession, stubs: Sequence[str], out_stub: str, types: Sequence[str]) -> None:
    """Several CSV feature sets as one."""
    write_features_csv(read_features_multi(spark, stubs, types), out_stub)


def write_manifest(df: DataFrame, path: str) -> None:
    """Which partition an item is processed in: ``id     :       part``."""
    line = F.concat(F.col("id"), F.lit("     :       "), F.spark_partition_id().cast("string"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def audit(waveforms: DataFrame, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """``(decoded, errors)``: the properties of good files, the messages of bad ones."""
    good = waveforms.where(F.col("error").isNull()).select(
        F.col(path_col).alias("filename"),
        F.lit("wav").alias("decoder"),
        F.col("sample_rate"),
        (F.col("sample_width") * 8).alias("sample_bits"),
        "n_channels",
        "n_samples",
    )
    bad = waveforms.where(F.col("error").isNotNull()).select(F.col(path_col).alias("filename"), "error")
    return good, bad


def append_new_only(new: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append the items whose id the table at ``path`` does not hold yet.

    Within ``new`` one row per id is kept, the smallest, so a rerun is harmless.
    """
    spark = new.sparkSession
    others = [c for c in new.columns if c != "id"]
    once = new.groupBy("id").agg(F.min(F.struct(*others)).alias("_row")).select("id", "_row.*") if others else new.distinct()
    existing = try_parquet(spark, path, fmt)
    fresh = once if existing is None else anti_existing(once, existing)
    fresh.select(*new.columns).write.mode("append").format(fmt).save(path)


def write_csv_encoded(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    encoding: str = "utf-8",
    header: bool = False,
    extras: str = "raise",
) -> None:
    """CSV in a target encoding, NULL as the empty string.

    Columns outside ``columns`` are an error or are left out.
    """
    if extras not in ("raise", "ignore"):
        raise ValueError(f"unknown rule for other columns: {extras}")
    wanted = list(columns) if columns else df.columns
    extra = [c for c in df.columns if c not in wanted]
    if extra and extras == "raise":
        raise ValueError(f"columns outside the target: {extra}")
    df.select(*wanted).write.mode("overwrite").csv(
        path, encoding=encoding, header=header, nullValue="", emptyValue="", quote='"', escape='"'
    )
