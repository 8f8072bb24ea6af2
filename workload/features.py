"""Projections, parsers, feature-set tools, statistics and beat models."""

from __future__ import annotations

from pyspark.sql import functions as F

from echorank.functions import ids as I
from echorank.functions import pitch as P
from echorank.functions import vectors as V
from echorank.functions.gaussian import gaussian_terms
from echorank.operators import beats as B
from echorank.operators import integrity, joins, moments
from echorank.operators.filters import valid_chroma
from echorank.operators.models import gaussian_model
from echorank.operators.pairing import distance_pairs, load_queries
from echorank.sinks.text import feature_line
from echorank.sources import lines as L

from .catalogue import TABLES_SQL, _KEYS, feature_tables, rounded, table, vectors
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


# Exact ties (0.0078125) would be decided by the last bit of a sum: both sides
# compare values moved off the rounding edge.
NUDGE = 3e-12


def _as_text(column):
    """Lists compare as text: one value per cell, whatever reads it."""
    return F.array_join(F.transform(column, lambda v: F.format_string("%.8f", F.round(v + NUDGE, 8) + 0.0)), ",")


def _text_sql(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda v: printf('%.8f', round(CAST(v AS DOUBLE) + {NUDGE!r}, 8) + 0.0)), ',')"


# --- ids and paths --------------------------------------------------------------

_PATH_SQL = "source || '/' || lang || ' mix/Track, ' || doc_id || '; live.' || (['mp3','wav','aiff','flac'])[doc_id % 4 + 1]"


def media_paths(spark, sf_dir):
    """A media path per document, with the characters ids must lose."""
    suffix = F.get(F.array(*[F.lit(s) for s in ("mp3", "wav", "aiff", "flac")]), (F.col("doc_id") % 4).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit(" mix/Track, "), "doc_id", F.lit("; live."), suffix)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


@register("normalize_id", f"SELECT doc_id, regexp_replace({_PATH_SQL}, '[;., ]', '', 'g') AS id FROM documents")
def normalize_id(spark, sf_dir):
    return media_paths(spark, sf_dir).select("doc_id", I.normalize_id("path").alias("id"))


@register(
    "file_id",
    f"""SELECT doc_id, regexp_replace(bare, '(mp3|aiff|aif|au|m4a|wav|flac|ogg)$', '.\\1') AS id,
  replace(replace(replace(replace(replace(replace(replace(replace(bare, 'mp3', '.mp3'), 'aiff', '.aiff'), 'aif', '.aif'),
    'au', '.au'), 'm4a', '.m4a'), 'wav', '.wav'), 'flac', '.flac'), 'ogg', '.ogg') AS compat_id
FROM (SELECT doc_id, regexp_replace({_PATH_SQL}, '[;.,]', '', 'g') AS bare FROM documents)""",
)
def file_id(spark, sf_dir):
    return media_paths(spark, sf_dir).select(
        "doc_id", I.file_id("path").alias("id"), I.file_id("path", compat=True).alias("compat_id")
    )


@register(
    "class_label",
    f"""SELECT doc_id, trim(string_split(p, '/')[-2]) AS by_directory, string_split(p, '.')[1] AS by_prefix
FROM (SELECT doc_id, {_PATH_SQL} AS p FROM documents)""",
)
def class_label(spark, sf_dir):
    return media_paths(spark, sf_dir).select(
        "doc_id", I.class_label("path").alias("by_directory"), I.class_label("path", "prefix").alias("by_prefix")
    )


@register(
    "repair_delimiter",
    f"""SELECT doc_id, regexp_replace(replace(replace(l, ' ', ''), ';', ','), '\\.(mp3|aiff|aif|au|m4a|wav|flac|ogg),', '.\\1;', 'g') AS line
FROM (SELECT doc_id, {_PATH_SQL} || '; ' || doc_id || '; [1, 2]' AS l FROM documents)""",
)
def repair_delimiter(spark, sf_dir):
    line = F.concat("path", F.lit("; "), "doc_id", F.lit("; [1, 2]"))
    return media_paths(spark, sf_dir).select("doc_id", I.repair_delimiter(line).alias("line"))


# --- vectors -----------------------------------------------------------------------

_E = f"WITH {TABLES_SQL} "


@register("concat_features", _E + f"SELECT id, {_text_sql('list_concat(rp, rh, bh)')} AS vec, 44 AS dim FROM feat")
def concat_features(spark, sf_dir):
    t = feature_tables(spark, sf_dir)
    wide = joins.assemble_features([t["rp"], t["rh"], t["bh"]], dedupe=False)
    vec = V.concat_features("rp+rh+bh")
    return wide.select("id", _as_text(vec).alias("vec"), F.size(vec).alias("dim"))


@register(
    "upper_triangle",
    _E + f"""SELECT id, {_text_sql("[e[1],e[2],e[3],e[4],e[6],e[7],e[8],e[11],e[12],e[16]]")} AS upper FROM vec""",
)
def upper_triangle(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", _as_text(V.upper_triangle(F.slice("e", 1, 16), 4)).alias("upper"))


@register("decode_matrix", _E + f"SELECT id, {_text_sql('e[1:7]')} AS mean, {_text_sql('e[8:56]')} AS cov, 7 AS d FROM vec")
def decode_matrix(spark, sf_dir):
    model = F.slice("e", 1, 56)
    return vectors(spark, sf_dir).select(
        "id",
        _as_text(V.model_mean(model, 7)).alias("mean"),
        _as_text(V.model_covariance(model, 7)).alias("cov"),
        V.matrix_order(model).alias("d"),
    )


@register(
    "to_feature_frame",
    _E + "SELECT " + ", ".join(f"e[{i + 1}] AS feat{i}" for i in range(64)) + ", id AS \"ID\", CAST(label AS VARCHAR) AS class FROM vec",
)
def to_feature_frame(spark, sf_dir):
    return V.to_feature_frame(vectors(spark, sf_dir), "e", 64, id_col="id", class_col="label")


@register(
    "select_ids_ordered",
    _E + f"SELECT x.id, {_text_sql('x.rh')} AS rh FROM feat x JOIN (VALUES ('song9'),('song2'),('song40'),('song2')) w(id) USING (id)",
)
def select_ids_ordered(spark, sf_dir):
    picked = integrity.select_ids_ordered(feature_tables(spark, sf_dir)["rh"], ["song9", "song2", "song40", "song2"])
    return picked.select("id", _as_text("rh").alias("rh"))


@register(
    "normalize_pcm_mono",
    _E + f"""SELECT id, {_text_sql('list_transform(range(1, 33), lambda k: (round(e[k]*1000) + round(e[k+32]*1000)) / 2 / 32768.0)')} AS mono FROM vec""",
)
def normalize_pcm_mono(spark, sf_dir):
    from echorank.functions.loudness import normalize_pcm, to_mono

    left, right = F.slice("e", 1, 32), F.slice("e", 33, 32)
    stereo = F.zip_with(left, right, lambda a, b: F.array(F.round(a * 1000), F.round(b * 1000)))
    return vectors(spark, sf_dir).select("id", _as_text(to_mono(normalize_pcm(stereo, F.lit(2)))).alias("mono"))


# --- notes and keys ------------------------------------------------------------------

_PITCH_SQL = f"""pit AS (SELECT doc_id, ([{_KEYS}])[doc_id % 12 + 1] AS key,
  list_transform(string_split(text, ' '), lambda w: CAST(length(w) % 12 AS INTEGER)) AS p FROM documents)"""


def pitch_table(spark, sf_dir):
    keys = F.array(*[F.lit(p) for p in P.PITCHES])
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.get(keys, (F.col("doc_id") % 12).cast("int")).alias("key"),
        F.transform(F.split("text", " "), lambda w: (F.length(w) % 12).cast("int")).alias("p"),
    )


@register(
    "encode_pitches",
    f"WITH {_PITCH_SQL} SELECT doc_id, '[' || array_to_string(list_transform(p, lambda n: chr(65 + n)), '') || ']' AS notes FROM pit",
)
def encode_pitches(spark, sf_dir):
    text = F.concat(F.lit("["), F.array_join(F.col("p").cast("array<string>"), ", "), F.lit("]"))
    return pitch_table(spark, sf_dir).select("doc_id", P.encode_pitches(text).alias("notes"))


@register(
    "transpose_notes",
    f"""WITH {_PITCH_SQL} SELECT doc_id, array_to_string(list_transform(p, lambda n: chr(CAST(65 + (n + 12 - doc_id % 12) % 12 AS INTEGER))), '') AS notes FROM pit""",
)
def transpose_notes(spark, sf_dir):
    moved = P.transpose_notes("key", "p")
    return pitch_table(spark, sf_dir).select("doc_id", P.encode_pitch_array(moved).alias("notes"))


@register(
    "transpose_chroma",
    _E
    + f"""SELECT id, {_text_sql('list_concat(e[(label*5)+1:60], e[1:label*5])')} AS chroma FROM vec""",
)
def transpose_chroma(spark, sf_dir):
    keys = F.array(*[F.lit(p) for p in P.PITCHES])
    moved = P.transpose_chroma(F.get(keys, F.col("label")), F.slice("e", 1, 60))
    return vectors(spark, sf_dir).select("id", _as_text(moved).alias("chroma"))


# --- text lines, written and parsed again -------------------------------------------------


def _line_parse(name: str, ext: str, parser, build, fields: dict[str, str], sql: str):
    @register(f"parse_{name}", sql)
    def run(spark, sf_dir):
        parsed = parser(build(spark, sf_dir).select(feature_line(ext, None).alias("value")))
        return parsed.select(*[(_as_text(c) if kind == "list" else F.col(c)).alias(c) for c, kind in fields.items()])


_ID_SQL = "replace(replace('music/' || id || '.mp3', '.', ''), ' ', '')"


def _with_path(df):
    return df.withColumn("id", F.concat(F.lit("music/"), "id", F.lit(".mp3")))


def _tables(name: str):
    return lambda spark, sf_dir: _with_path(feature_tables(spark, sf_dir)[name])


_line_parse(
    "vector_csv", "rp", lambda df: L.parse_vector_csv(df, "rp"), _tables("rp"), {"id": "text", "rp": "list"},
    _E + f"SELECT {_ID_SQL} AS id, {_text_sql('rp')} AS rp FROM feat",
)
_line_parse(
    "vector_csv_bracketed", "rh", lambda df: L.parse_vector_csv_bracketed(df, "rh"), _tables("rh"), {"id": "text", "rh": "list"},
    _E + f"SELECT {_ID_SQL} AS id, {_text_sql('rh')} AS rh FROM feat",
)
_line_parse(
    "beat_histogram", "bh", L.parse_beat_histogram, _tables("bh"), {"id": "text", "bpm": "number", "bh": "list"},
    _E + f"SELECT {_ID_SQL} AS id, bpm, {_text_sql('bh')} AS bh FROM feat",
)
_line_parse(
    "chroma", "chroma", L.parse_chroma,
    lambda spark, sf_dir: _tables("chroma")(spark, sf_dir).withColumn("chroma", F.transform("chroma", lambda v: F.round(v, 3))),
    {"id": "text", "chroma": "list"},
    _E + f"SELECT {_ID_SQL} AS id, {_text_sql('list_transform(chroma, lambda v: round(v, 3))')} AS chroma FROM feat WHERE round(chroma[1], 3) < 2",
)
_line_parse(
    "mfcc_model", "mfcckl", lambda df: L.parse_mfcc_model(df, size=None),
    lambda spark, sf_dir: _tables("mfcc")(spark, sf_dir).select("id", F.slice("mfcc", 1, 2).alias("mean"), F.slice("mfcc", 3, 4).alias("cov")),
    {"id": "text", "mfcc": "list"},
    _E + f"SELECT {_ID_SQL} AS id, {_text_sql('[m1, m2, c11, c12, c12, c22]')} AS mfcc FROM feat",
)
_line_parse(
    "mfcc_statistics", "mfcc", L.parse_mfcc_statistics,
    lambda spark, sf_dir: _with_path(
        vectors(spark, sf_dir).select(
            "id", F.slice("e", 1, 13).alias("mean"), F.slice("e", 14, 13).alias("var"), F.slice("e", 27, 38).alias("cov_ut")
        )
    ),
    {"id": "text", "mean": "list", "var": "list", "cov_ut": "list"},
    _E + f"SELECT {_ID_SQL} AS id, {_text_sql('e[1:13]')} AS mean, {_text_sql('e[14:26]')} AS var, {_text_sql('e[27:64]')} AS cov_ut FROM vec",
)
_line_parse(
    "notes", "notes", L.parse_notes,
    lambda spark, sf_dir: pitch_table(spark, sf_dir).select(
        F.concat(F.lit("music/song "), "doc_id", F.lit(".wav")).alias("id"), "key", F.lit("minor").alias("scale"), F.col("p").alias("pitches")
    ),
    {"id": "text", "key": "text", "scale": "text", "notes": "text"},
    f"""WITH {_PITCH_SQL} SELECT 'music/song' || doc_id || 'wav' AS id, key, 'minor' AS scale,
  '[' || array_to_string(list_transform(p, lambda n: chr(65 + n)), '') || ']' AS notes FROM pit""",
)


@register(
    "valid_chroma",
    _E + "SELECT id, chroma[1] < 2 AND abs(e1) < 1 AS valid FROM (SELECT id, chroma, vec.e[1] AS e1 FROM feat JOIN vec USING (id))",
)
def valid_chroma_query(spark, sf_dir):
    chroma = F.transform(F.slice("e", 41, 24), F.abs)
    payload = F.when(F.abs(F.col("e")[0]) < 1, V.format_matrix(chroma, 12)).otherwise(F.lit("[]"))
    return vectors(spark, sf_dir).select("id", valid_chroma(payload).alias("valid"))


# --- feature-set checks ----------------------------------------------------------------------


@register("duplicate_ids", "SELECT source AS id, count(*) AS count FROM documents GROUP BY source HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return integrity.duplicate_ids(table(spark, sf_dir, "documents").select(F.col("source").alias("id")))


@register(
    "id_consistency",
    """SELECT id, count(*) FILTER (t = 'rp') AS rp, count(*) FILTER (t = 'notes') AS notes FROM (
  SELECT 'song' || vec_id AS id, 'rp' AS t FROM embeddings UNION ALL SELECT 'song' || doc_id, 'notes' FROM documents)
GROUP BY id HAVING count(*) FILTER (t = 'rp') <> count(*) FILTER (t = 'notes')""",
)
def id_consistency(spark, sf_dir):
    t = feature_tables(spark, sf_dir)
    return integrity.id_consistency({"rp": t["rp"], "notes": t["notes"]})


@register("dedupe", "SELECT DISTINCT event_type, user_id FROM events")
def dedupe(spark, sf_dir):
    return integrity.dedupe(table(spark, sf_dir, "events").select("event_type", "user_id"))


@register(
    "anti_existing",
    _E + "SELECT id, key, scale FROM nts WHERE id NOT IN (SELECT id FROM vec)",
)
def anti_existing(spark, sf_dir):
    t = feature_tables(spark, sf_dir)
    return joins.anti_existing(t["notes"], t["rp"]).select("id", "key", "scale")


# --- statistics ----------------------------------------------------------------------------------

_MOMENTS_SQL = """m AS (SELECT {keys}, avg(x) AS mean, var_pop(x) AS var, median(x) AS median, min(x) AS min, max(x) AS max FROM {src} GROUP BY {keys}),
mm AS (SELECT {keys}, any_value(m.mean) AS mean, any_value(m.var) AS var, any_value(m.median) AS median, any_value(m.min) AS min, any_value(m.max) AS max,
  CASE WHEN any_value(m.var) > 1e-24 THEN avg((x - m.mean)^3) / any_value(m.var)^1.5 ELSE 0 END AS skew,
  CASE WHEN any_value(m.var) > 1e-24 THEN avg((x - m.mean)^4) / any_value(m.var)^2 ELSE 0 END AS kurtosis
  FROM {src} JOIN m USING ({keys}) GROUP BY {keys})"""
_MOMENT_COLUMNS = ", ".join(f"round({m}, 5) AS {m}" for m in moments.MOMENTS)


@register(
    "moments7",
    "WITH src AS (SELECT event_type, value AS x FROM events), "
    + _MOMENTS_SQL.format(keys="event_type", src="src")
    + f" SELECT event_type, {_MOMENT_COLUMNS} FROM mm",
)
def moments7(spark, sf_dir):
    stats = moments.moments7(table(spark, sf_dir, "events"), ["event_type"], "value")
    return rounded(stats, *moments.MOMENTS, digits=5)


@register(
    "moments7_flat",
    """SELECT event_type, round(avg(x), 6) AS mean, 0.0::DOUBLE AS var, 0.0::DOUBLE AS skew, 0.0::DOUBLE AS kurtosis, round(median(x), 6) AS median,
  round(min(x), 6) AS min, round(max(x), 6) AS max
FROM (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 0.30000000000000004::DOUBLE ELSE 0.3::DOUBLE END AS x FROM events) GROUP BY event_type""",
)
def moments7_flat(spark, sf_dir):
    """Groups that are constant but for the last digit of their values."""
    x = F.when(F.col("user_id") % 2 == 0, F.lit(0.1) + F.lit(0.2)).otherwise(F.lit(0.3))
    stats = moments.moments7(table(spark, sf_dir, "events").select("event_type", x.alias("x")), ["event_type"], "x")
    return rounded(stats, "mean", "median", "min", "max")


@register("grouped_median", "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def grouped_median(spark, sf_dir):
    """Every group goes the way of large groups here."""
    medians = moments.grouped_median(table(spark, sf_dir, "events"), ["event_type"], "value", small_group=0)
    return rounded(medians, "median")


_SEGMENTS = "seg AS (SELECT label, unnest(range(1, 65)) - 1 AS pos, unnest(e) AS x FROM vec)"


@register("segment_mean", _E + f", {_SEGMENTS} SELECT label, array_to_string(list(printf('%.8f', round(m + 3e-12, 8) + 0.0) ORDER BY pos), ',') AS vec FROM (SELECT label, pos, avg(x) AS m FROM seg GROUP BY ALL) GROUP BY label")
def segment_mean(spark, sf_dir):
    return moments.segment_mean(vectors(spark, sf_dir), ["label"], "e", "vec").select("label", _as_text("vec").alias("vec"))


@register("segment_median", _E + f", {_SEGMENTS} SELECT label, array_to_string(list(printf('%.8f', round(m + 3e-12, 8) + 0.0) ORDER BY pos), ',') AS vec FROM (SELECT label, pos, median(x) AS m FROM seg GROUP BY ALL) GROUP BY label")
def segment_median(spark, sf_dir):
    return moments.segment_median(vectors(spark, sf_dir), ["label"], "e", "vec").select("label", _as_text("vec").alias("vec"))


@register(
    "segment_stats",
    _E
    + f", {_SEGMENTS}, "
    + _MOMENTS_SQL.format(keys="label, pos", src="seg")
    + ", parts AS (" + " UNION ALL ".join(f"SELECT label, {n} AS part, pos, {m} AS v FROM mm" for n, m in enumerate(moments.MOMENTS)) + ")"
    + " SELECT label, array_to_string(list(printf('%.4f', round(v, 4) + 0.0) ORDER BY part, pos), ',') AS vec FROM parts GROUP BY label",
)
def segment_stats(spark, sf_dir):
    stats = moments.segment_stats(vectors(spark, sf_dir), ["label"], "e", "vec")
    text = F.array_join(F.transform("vec", lambda v: F.format_string("%.4f", F.round(v, 4) + 0.0)), ",")
    return stats.select("label", text.alias("vec"))


# --- Gaussian models of frames: (value, minute) per user -----------------------------------------------


def event_frames(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    pair = F.array(F.col("value"), F.minute("ts").cast("double"))
    return events.select(F.col("user_id").cast("string").alias("id"), pair.alias("v"))


_GAUSS_SQL = """g AS (SELECT CAST(user_id AS VARCHAR) AS id, avg(value) AS m1, avg(mi) AS m2, var_pop(value) AS v1, var_pop(mi) AS v2,
  var_samp(value) AS c11, covar_samp(value, mi) AS c12, var_samp(mi) AS c22
  FROM (SELECT user_id, value, CAST(minute(ts) AS DOUBLE) AS mi FROM events) GROUP BY user_id)"""


@register(
    "gaussian_model",
    f"WITH {_GAUSS_SQL} SELECT id, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("m1", "m2", "v1", "v2", "c11", "c12", "c22")) + " FROM g",
)
def gaussian_model_query(spark, sf_dir):
    model = gaussian_model(event_frames(spark, sf_dir), d=2)
    parts = {"m1": F.col("mean")[0], "m2": F.col("mean")[1], "v1": F.col("var")[0], "v2": F.col("var")[1],
             "c11": F.col("cov")[0], "c12": F.col("cov_ut")[1], "c22": F.col("cov")[3]}
    return model.select("id", *[F.round(c, 5).alias(n) for n, c in parts.items()])


def _gauss_distances() -> str:
    from .catalogue import DISTANCE_SQL

    return f"round({DISTANCE_SQL['distances_skl']}, 5) AS distances_skl, round({DISTANCE_SQL['distances_js']}, 5) AS distances_js"


@register(
    "gaussian_skl_js",
    f"WITH {_GAUSS_SQL} SELECT q.id AS query_id, x.id, {_gauss_distances()} FROM g x JOIN g q ON q.id IN ('1', '4', '9')",
)
def gaussian_skl_js(spark, sf_dir):
    models = gaussian_model(event_frames(spark, sf_dir), d=2).select("id", "mfcc")
    pairs = distance_pairs(models, load_queries(models, ["1", "4", "9"], ["mfcc"]), ["skl", "js"])
    return rounded(pairs, "distances_skl", "distances_js", digits=5)


@register(
    "gaussian_terms",
    f"""WITH {_GAUSS_SQL} SELECT id, round(c22 / (c11*c22 - c12^2), 6) AS i11, round(c11 / (c11*c22 - c12^2), 6) AS i22,
  round(ln(c11*c22 - c12^2), 6) AS log_det, true AS invertible FROM g""",
)
def gaussian_terms_query(spark, sf_dir):
    t = gaussian_model(event_frames(spark, sf_dir), d=2).select("id", gaussian_terms("mfcc").alias("t"))
    return t.select(
        "id", F.round(F.col("t.diag_inv")[0], 6).alias("i11"), F.round(F.col("t.diag_inv")[1], 6).alias("i22"),
        F.round("t.log_det", 6).alias("log_det"), "t.invertible",
    )


# --- beats: clicks are beats, other events frames, ticks are seconds ---------------------------------------

_TICK_SQL = "CAST(epoch_us(ts) // 1000000 - 1704067200 AS BIGINT)"


def event_beats(spark, sf_dir):
    """Frames with 12 bins and beats per user, one tick per second."""
    events = table(spark, sf_dir, "events").withColumn(
        "frame", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000) - 1704067200
    )
    cents = F.round(F.abs("value") * 100).cast("long")
    bins = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.pmod(cents * i, F.lit(101)) / 100.0)
    events = events.select(F.col("user_id").alias("id"), "event_type", "frame", bins.alias("v"))
    clicks = F.col("event_type") == "click"
    return events.where(~clicks).select("id", "frame", "v"), events.where(clicks).select("id", "frame")


_WIDTH = 86400

_BEATS_SQL = f"""ev AS (SELECT user_id AS id, event_type, {_TICK_SQL} AS frame,
    list_transform(range(1, 13), lambda i: ((CAST(round(abs(value) * 100) AS BIGINT) * i) % 101) / 100.0) AS v FROM events),
bt AS (SELECT id, coalesce(lag(frame) OVER (PARTITION BY id ORDER BY frame), 0) AS s, frame AS beat FROM ev WHERE event_type = 'click'),
fr AS (SELECT * FROM ev WHERE event_type <> 'click'),
jn AS (SELECT bt.id, bt.s, bt.beat, fr.v FROM bt LEFT JOIN fr ON fr.id = bt.id AND fr.frame >= bt.s AND fr.frame < bt.beat)"""
_MEANS_SQL = ", ".join(f"coalesce(avg(v[{i}]), 0)" for i in range(1, 13))


@register("interval_join", f"WITH {_BEATS_SQL} SELECT bt.id, bt.s AS start, bt.beat AS \"end\", fr.frame FROM bt JOIN fr ON fr.id = bt.id AND fr.frame >= bt.s AND fr.frame < bt.beat")
def interval_join(spark, sf_dir):
    frames, beats = event_beats(spark, sf_dir)
    intervals = B.beat_intervals(beats, width=_WIDTH).drop("copies")
    return joins.interval_join(frames, intervals, "id", "frame", "start", "end", _WIDTH).select("id", "start", "end", "frame")


@register(
    "beat_means",
    f"WITH {_BEATS_SQL} SELECT id, beat, count(v) AS n, {_text_sql(f'[{_MEANS_SQL}]')} AS mean FROM jn GROUP BY id, s, beat",
)
def beat_means(spark, sf_dir):
    frames, beats = event_beats(spark, sf_dir)
    return B.beat_means(frames, beats, _WIDTH).select("id", "beat", "n", _as_text("mean").alias("mean"))


@register(
    "beat_chroma",
    f"""WITH {_BEATS_SQL}, mn AS (SELECT id, beat, [{_MEANS_SQL}] AS m FROM jn GROUP BY id, s, beat)
SELECT id, beat, {_text_sql('list_transform(m, lambda x: CASE WHEN list_sum(m) <> 0 THEN x / list_sum(m) ELSE x END)')} AS chroma FROM mn""",
)
def beat_chroma(spark, sf_dir):
    frames, beats = event_beats(spark, sf_dir)
    return B.beat_chroma(frames, beats, _WIDTH).select("id", "beat", _as_text("chroma").alias("chroma"))


_STRONG_SQL = "list_transform({v}, lambda x: CASE WHEN x = list_max({v}) THEN 1.0 WHEN x < 0.8 THEN 0.0 ELSE CAST(x AS DOUBLE) END)"
_SILENT_SQL = "list_transform(range(0, 12), lambda i: 0.0)"


@register(
    "beat_notes",
    f"""WITH {_BEATS_SQL}, li AS (SELECT id, avg(list_sum(v)) / 2 AS lim FROM fr GROUP BY id),
hd AS (SELECT jn.id, s, beat, CASE WHEN v IS NULL OR list_sum(v) <= lim THEN {_SILENT_SQL} ELSE {_STRONG_SQL.format(v='v')} END AS h FROM jn LEFT JOIN li USING (id)),
sm AS (SELECT id, beat, [{', '.join(f'round(sum(h[{i}]), 9)' for i in range(1, 13))}] AS t FROM hd GROUP BY id, s, beat)
SELECT id, beat, CAST(list_position(t, list_max(t)) - 1 AS INTEGER) AS note FROM sm""",
)
def beat_notes(spark, sf_dir):
    frames, beats = event_beats(spark, sf_dir)
    return B.beat_notes(frames, beats, width=_WIDTH)


@register(
    "beat_notes_pre_averaged",
    f"""WITH {_BEATS_SQL}, li AS (SELECT id, avg(list_sum(v)) / 2 AS lim FROM fr GROUP BY id),
mn AS (SELECT id, beat, list_transform([{_MEANS_SQL}], lambda x: round(x, 9)) AS m FROM jn GROUP BY id, s, beat),
hd AS (SELECT id, beat, CASE WHEN list_sum(m) > lim THEN {_STRONG_SQL.format(v='m')} ELSE {_SILENT_SQL} END AS h FROM mn LEFT JOIN li USING (id))
SELECT id, beat, CAST(list_position(h, list_max(h)) - 1 AS INTEGER) AS note FROM hd""",
)
def beat_notes_pre_averaged(spark, sf_dir):
    frames, beats = event_beats(spark, sf_dir)
    return B.beat_notes(frames, beats, pre_averaged=True, width=_WIDTH)


@register(
    "note_sequences",
    f"""WITH {_BEATS_SQL}, mn AS (SELECT id, beat, s, [{_MEANS_SQL}] AS m FROM jn GROUP BY id, s, beat)
SELECT id, count(*) AS beats, {_text_sql('list_concat(' + ', '.join(f'list(m[{i}] ORDER BY beat, s)' for i in range(1, 13)) + ')')} AS rows FROM mn GROUP BY id""",
)
def note_sequences(spark, sf_dir):
    """Beat means as one matrix of twelve rows per item."""
    frames, beats = event_beats(spark, sf_dir)
    means = B.beat_means(frames, beats, _WIDTH).select("id", "beat", F.col("mean").alias("chroma"))
    matrix = B.chroma_matrix(means)
    return matrix.select("id", (F.size("chroma") / 12).cast("long").alias("beats"), _as_text("chroma").alias("rows"))


@register(
    "note_pitches",
    f"""WITH {_BEATS_SQL}, li AS (SELECT id, avg(list_sum(v)) / 2 AS lim FROM fr GROUP BY id),
hd AS (SELECT jn.id, s, beat, CASE WHEN v IS NULL OR list_sum(v) <= lim THEN {_SILENT_SQL} ELSE {_STRONG_SQL.format(v='v')} END AS h FROM jn LEFT JOIN li USING (id)),
sm AS (SELECT id, beat, s, [{', '.join(f'round(sum(h[{i}]), 9)' for i in range(1, 13))}] AS t FROM hd GROUP BY id, s, beat)
SELECT id, string_agg(CAST(list_position(t, list_max(t)) - 1 AS VARCHAR), ',' ORDER BY beat, CAST(list_position(t, list_max(t)) - 1 AS INTEGER)) AS pitches FROM sm GROUP BY id""",
)
def note_pitches(spark, sf_dir):
    """The notes of every item in the order of its beats."""
    frames, beats = event_beats(spark, sf_dir)
    notes = B.note_sequence(B.beat_notes(frames, beats, width=_WIDTH))
    return notes.select("id", F.array_join(F.col("pitches").cast("array<string>"), ",").alias("pitches"))


_TEMPO_SQL = """cl AS (SELECT user_id AS id, epoch_us(ts) / 1e6 / 7200 AS t FROM events WHERE event_type = 'click'),
pr AS (SELECT id, t, lag(t) OVER (PARTITION BY id ORDER BY t) AS p FROM cl),
tp AS (SELECT id, 60 / (t - p) AS bpm FROM pr WHERE t > p)"""


def click_times(spark, sf_dir):
    """Clicks as beats, two hours to the second."""
    clicks = table(spark, sf_dir, "events").where(F.col("event_type") == "click")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return clicks.select(F.col("user_id").alias("id"), (micros / 1e6 / 7200).alias("t"))


@register(
    "tempo_bins",
    f"""WITH {_TEMPO_SQL}, b AS (SELECT id, CAST(floor(bpm) AS INTEGER) AS bin, count(*) AS n FROM tp WHERE floor(bpm) BETWEEN 0 AND 249 GROUP BY ALL)
SELECT id, bin, n, round(n / sum(n) OVER (PARTITION BY id), 6) AS share FROM b""",
)
def tempo_bins(spark, sf_dir):
    return rounded(B.tempo_bins(click_times(spark, sf_dir)), "share")


@register(
    "tempo_histogram",
    f"""WITH {_TEMPO_SQL}, b AS (SELECT id, CAST(floor(bpm) AS INTEGER) AS bin, count(*) AS n FROM tp WHERE floor(bpm) BETWEEN 0 AND 249 GROUP BY ALL),
d AS (SELECT i.id, g.bin, coalesce(b.n, 0) AS n FROM (SELECT DISTINCT id FROM cl) i CROSS JOIN (SELECT unnest(range(0, 250)) AS bin) g LEFT JOIN b ON b.id = i.id AND b.bin = g.bin),
h AS (SELECT id, array_to_string(list(printf('%.8f', CASE WHEN total = 0 THEN 0 ELSE round(n / total + 3e-12, 8) END) ORDER BY bin), ',') AS bh FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS total FROM d) GROUP BY id)
SELECT h.id, round(m.bpm, 5) AS bpm, h.bh FROM h LEFT JOIN (SELECT id, median(bpm) AS bpm FROM tp GROUP BY id) m USING (id)""",
)
def tempo_histogram(spark, sf_dir):
    tempo = B.tempo_histogram(click_times(spark, sf_dir))
    return tempo.select("id", F.round("bpm", 5).alias("bpm"), _as_text("bh").alias("bh"))
