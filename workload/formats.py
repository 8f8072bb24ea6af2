"""Writers and readers: every query writes a derived table and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from echorank.functions.vectors import to_feature_frame
from echorank.operators.ordering import with_position
from echorank.sinks import columnar, text
from echorank.session import scratch_path
from echorank.sources import lines, tables
from echorank.sources.media import scan_media
from echorank.streaming.append_new import append_new_stream
from echorank.streaming.once import append_once_stream

from .catalogue import TABLES_SQL, feature_tables, table, vectors
from .features import _as_text, _text_sql
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
_E = f"WITH {TABLES_SQL} "


def _sets(spark, sf_dir):
    t = feature_tables(spark, sf_dir)
    return {"rp": t["rp"], "rh": t["rh"]}


def _both(read):
    return read["rp"].join(read["rh"], "id").select("id", _as_text("rp").alias("rp"), _as_text("rh").alias("rh"))


_BOTH_SQL = _E + f"SELECT id, {_text_sql('rp')} AS rp, {_text_sql('rh')} AS rh FROM feat"


@register("features_csv", _BOTH_SQL)
def features_csv(spark, sf_dir):
    stub = scratch_path(spark, "csv")
    text.write_features_csv(_sets(spark, sf_dir), stub)
    return _both(tables.read_feature_set(spark, stub, ["rp", "rh"]))


@register("features_csv_id2", _E + f"SELECT vec.id, CAST(label AS VARCHAR) AS id2, {_text_sql('rh')} AS vec FROM feat JOIN vec USING (id)")
def features_csv_id2(spark, sf_dir):
    stub = scratch_path(spark, "csv")
    labelled = vectors(spark, sf_dir).select("id", F.col("label").cast("string").alias("id2"), F.slice("e", 25, 12).alias("rh"))
    text.write_features_csv({"rh": labelled}, stub)
    read = tables.read_features_csv(spark, f"{stub}.rh", id_column=[0, 1])
    return read.select("id", "id2", _as_text("vec").alias("vec"))


@register("features_csv_append", _E + "SELECT id, count(*) AS n FROM (SELECT id FROM feat UNION ALL SELECT id FROM feat) GROUP BY id")
def features_csv_append(spark, sf_dir):
    stub = scratch_path(spark, "csv")
    own = {"rh": _sets(spark, sf_dir)["rh"]}
    text.write_features_csv(own, stub)
    text.write_features_csv(own, stub, append=True)
    return tables.read_features_csv(spark, f"{stub}.rh", ids_only=True).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@register("features_csv_ragged", _E + f"SELECT vec.id, 1 + label % 3 AS n, {_text_sql('feat.rh[1 : 1 + label % 3]')} AS vec FROM feat JOIN vec USING (id)")
def features_csv_ragged(spark, sf_dir):
    """Lines of one, two and three numbers: each keeps what it has."""
    path = scratch_path(spark, "csv")
    some = F.slice(F.slice("e", 25, 12), F.lit(1), (F.col("label") % 3 + 1).cast("int"))
    line = F.concat_ws(",", F.concat(F.lit('"'), "id", F.lit('"')), F.transform(some, lambda x: x.cast("string")))
    vectors(spark, sf_dir).select(line.alias("value")).write.text(path)
    read = tables.read_features_csv(spark, path, ragged="keep")
    return read.select("id", F.size("vec").cast("int").alias("n"), _as_text("vec").alias("vec"))


@register("columnar_round_trip", _BOTH_SQL)
def columnar_round_trip(spark, sf_dir):
    stub = scratch_path(spark, "columnar")
    columnar.write_columnar(_sets(spark, sf_dir), stub)
    return _both(tables.load_features(spark, stub, ["rp", "rh"]))


@register("csv_to_columnar", _E + f"SELECT id, {_text_sql('rh')} AS rh FROM feat")
def csv_to_columnar(spark, sf_dir):
    """CSV → Parquet with 32-bit values → CSV."""
    stub = scratch_path(spark, "convert")
    text.write_features_csv({"rh": _sets(spark, sf_dir)["rh"]}, stub)
    columnar.csv_to_columnar(spark, f"{stub}.rh", stub, "rh", float32=True)
    columnar.columnar_to_csv(spark, stub, f"{stub}-back", ["rh"])
    read = tables.read_features_csv(spark, f"{stub}-back.rh", name="rh")
    return read.select("id", _as_text(F.col("rh").cast("array<float>").cast("array<double>")).alias("rh"))


@register("combine_feature_sets", _E + "SELECT id, 2 AS rp, 2 AS columnar FROM feat")
def combine_feature_sets(spark, sf_dir):
    stub = scratch_path(spark, "combine")
    own = {"rp": _sets(spark, sf_dir)["rp"]}
    text.write_features_csv(own, f"{stub}-a")
    text.write_features_csv(own, f"{stub}-b")
    text.concat_feature_files(spark, [f"{stub}-a", f"{stub}-b"], f"{stub}-ab", ["rp"])
    columnar.write_columnar(own, f"{stub}-a")
    columnar.combine_columnar(spark, [f"{stub}-a", f"{stub}-a"], f"{stub}-aa", ["rp"])
    counts = [
        tables.read_features_csv(spark, f"{stub}-ab.rp", ids_only=True).groupBy("id").agg(F.count(F.lit(1)).alias("rp")),
        spark.read.parquet(f"{stub}-aa.rp.parquet").groupBy("id").agg(F.count(F.lit(1)).alias("columnar")),
    ]
    return counts[0].join(counts[1], "id")


@register("arff_round_trip", _E + f"SELECT id, {_text_sql('e')} AS vec, CAST(label AS VARCHAR) AS class FROM vec")
def arff_round_trip(spark, sf_dir):
    path = scratch_path(spark, "arff")
    frame = to_feature_frame(vectors(spark, sf_dir), "e", 64, id_col="id", class_col="label")
    text.write_arff(frame, path, "vectors")
    return tables.read_arff(spark, path).select("id", _as_text("vec").alias("vec"), "class")


@register("csv_to_arff", _E + f"SELECT 'c' || label AS class, {_text_sql('e[25:36]')} AS vec FROM vec")
def csv_to_arff(spark, sf_dir):
    stub = scratch_path(spark, "arff")
    named = vectors(spark, sf_dir).select(F.concat(F.lit("c"), "label", F.lit("."), "id").alias("id"), F.slice("e", 25, 12).alias("rh"))
    text.write_features_csv({"rh": named}, stub)
    text.csv_to_arff(spark, stub, f"{stub}-out", ["rh"])
    return tables.read_arff(spark, f"{stub}-out.rh.arff").select("class", _as_text("vec").alias("vec"))


@register("feature_files", _E + f"SELECT id || 'mp3' AS id, bpm, {_text_sql('list_transform(bh, lambda v: round(v, 8))')} AS bh FROM feat")
def feature_files(spark, sf_dir):
    """Feature lines written below ``features1`` and found again by their pattern."""
    root = scratch_path(spark, "files")
    named = feature_tables(spark, sf_dir)["bh"].withColumn("id", F.concat("id", F.lit(".mp3")))
    text.write_feature_lines(named, f"{root}/features1/out0.bh", "bh")
    return lines.read_feature_files(spark, root, "bh").select("id", "bpm", _as_text("bh").alias("bh"))


@register("manifest", _E + "SELECT id FROM feat")
def manifest(spark, sf_dir):
    root = scratch_path(spark, "files")
    text.write_manifest(feature_tables(spark, sf_dir)["rh"], f"{root}/features1/out0.files")
    return lines.read_feature_files(spark, root, "files").where("part >= 0").select("id")


@register("file_list", "SELECT '/music/' || source || '/' || doc_id || '.mp3' AS path FROM documents")
def file_list(spark, sf_dir):
    path = scratch_path(spark, "list")
    names = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".mp3")).alias("value"))
    names.write.text(path)
    return lines.read_file_list(spark, path, "/music/")


@register("scan_media", "SELECT source AS folder, count(*) AS lines FROM documents GROUP BY source")
def scan_media_query(spark, sf_dir):
    """Files written per source, listed by suffix, and read through the list."""
    root = scratch_path(spark, "media")
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("value"))
    docs.write.partitionBy("source").text(root)
    listed = scan_media(spark, root, ".TXT", relative=True).select(F.col("path").alias("file"))
    rows = spark.read.text(root, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"))
    bare = F.regexp_replace("path", "^file:/+", "/")
    named = rows.select(F.substring(bare, F.lit(len(root) + 2), F.length(bare)).alias("file"))
    found = named.join(listed, "file", "left_semi")
    return found.groupBy(F.regexp_extract("file", "^source=([^/]+)/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("lines"))


@register("ranking_csv", "SELECT row_number() OVER (ORDER BY round(value, 2), CAST(event_id AS VARCHAR)) - 1 AS position, CAST(event_id AS VARCHAR) AS id FROM events")
def ranking_csv(spark, sf_dir):
    path = scratch_path(spark, "ranking")
    ranking = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.round("value", 2).alias("aggregated"))
    text.write_ranking_csv(ranking, path)
    return spark.read.schema("position long, id string, aggregated double").csv(path, header=True).select("position", "id")


@register("positions", "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, CAST(event_id AS VARCHAR)) - 1 AS position, CAST(event_id AS VARCHAR) AS id FROM events")
def positions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.col("event_id").cast("string").alias("id"), "value")
    return with_position(events, "value", ["event_type"]).select("event_type", "position", "id")


@register("append_new_only", "SELECT 'song' || id AS id, count(*) AS n FROM (SELECT vec_id AS id FROM embeddings UNION SELECT doc_id FROM documents) GROUP BY id")
def append_new_only(spark, sf_dir):
    path = scratch_path(spark, "append")
    t = feature_tables(spark, sf_dir)
    for source in ("rp", "notes", "rp"):
        text.append_new_only(t[source].select("id"), path)
    return spark.read.parquet(path).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@register("append_new_stream", _E + f"SELECT id || 'mp3' AS id, 1 AS n, {_text_sql('rh')} AS rh FROM feat")
def append_new_stream_query(spark, sf_dir):
    """The same files arrive twice; every id is stored once."""
    root = scratch_path(spark, "stream")
    named = feature_tables(spark, sf_dir)["rh"].withColumn("id", F.concat("id", F.lit(".mp3")))
    for _ in range(2):
        text.write_feature_lines(named, f"{root}/in", "rh", decimals=None, mode="append")
        append_new_stream(spark, f"{root}/in", f"{root}/table", f"{root}/checkpoint", "rh").awaitTermination()
    stored = spark.read.parquet(f"{root}/table")
    return stored.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first(_as_text("rh")).alias("rh"))


@register("append_once_stream", _E + f"SELECT id || 'mp3' AS id, 1 AS n, {_text_sql('rh')} AS rh FROM feat")
def append_once_stream_query(spark, sf_dir):
    """Part of the files, then all of them twice: the state knows the ids of every run before."""
    root = scratch_path(spark, "once")
    named = feature_tables(spark, sf_dir)["rh"].withColumn("id", F.concat("id", F.lit(".mp3")))
    for some in (named.where(F.crc32("id") % 3 == 0), named, named):
        text.write_feature_lines(some, f"{root}/in", "rh", decimals=None, mode="append")
        append_once_stream(spark, f"{root}/in", f"{root}/table", f"{root}/checkpoint", "rh").awaitTermination()
    stored = spark.read.parquet(f"{root}/table")
    return stored.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first(_as_text("rh")).alias("rh"))


@register("csv_encoded", "SELECT doc_id, source, lang FROM documents")
def csv_encoded(spark, sf_dir):
    path = scratch_path(spark, "encoded")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "lang", "n_chars")
    text.write_csv_encoded(docs, path, ["doc_id", "source", "lang"], "iso-8859-1", header=True, extras="ignore")
    read = tables.read_csv_encoded(spark, path, "iso-8859-1", max_field_size=100, header=True)
    return read.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang")
