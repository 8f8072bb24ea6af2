"""Signal features of waveforms built from ``embeddings``.

A vector is repeated to a tone of period 64, loud in the first segment and half
as loud in the second. All windows of a segment see the same samples, so every
feature has a closed form that SQL can compute from the 64 numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc, fs
from pyspark.sql import functions as F

from echorank.functions import loudness as S
from echorank.functions.arrow import WAVES, wave_batch
from echorank.functions.rhythm import RhythmOptions
from echorank.operators.segments import segment_errors, segment_signal, with_time
from echorank.plans import extraction as X
from echorank.plans.extraction import aggregate_features, extract_from_waveforms, file_segment_features
from echorank.session import SEGMENT_ROWS, materialize, scratch_path, spread_small
from echorank.sinks.text import audit
from echorank.sources.media import decode_wav
from echorank.sources.tables import read_features_csv
from echorank.streaming.media import extract_stream, streamed_features

from .catalogue import TABLES_SQL, table, vectors
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

RATE = 11025
DIGITS = 5


def waveforms(spark, sf_dir):
    def sound(batches):
        for batch in batches:
            for name, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                e = vector.values
                if e is not None and e.null_count:
                    at = np.tile(np.arange(len(e)), 1024)
                    e = pa.concat_arrays([e.take(at), pc.divide(e, 2.0).take(at)])
                elif e is not None:
                    e = pa.array(np.concatenate([np.tile(e, 1024), np.tile(np.asarray(e) / 2, 1024)]))
                yield wave_batch(name, RATE, e)

    base = spread_small(vectors(spark, sf_dir))  # spread the small vectors, not the waveforms
    return base.select("id", "e").mapInArrow(sound, WAVES)


def _text(column, digits: int = DIGITS):
    return F.array_join(F.transform(column, lambda v: F.format_string(f"%.{digits}f", F.round(v, digits) + 0.0)), ",")


def _agg_text(value: str, order: str, digits: int = DIGITS) -> str:
    return f"array_to_string(list(printf('%.{digits}f', round({value}, {digits}) + 0.0) ORDER BY {order}), ',')"


_EDGES = ", ".join(f"({n}, {lo}.0, {hi}.0)" for n, (lo, hi) in enumerate(zip((0, *S.BARK_EDGES), S.BARK_EDGES)))
_CURVES = ", ".join(
    f"({b}, {n}, {row[n - 1]!r}, {row[n]!r}, {float(S.PHON_LEVELS[n - 1])}, {float(S.PHON_LEVELS[n])})"
    for b, row in enumerate([[float(v) for v in r] for r in S.band_levels()])
    for n in range(1, 6)
)


def sonogram_sql(samples: str, segments: str) -> str:
    """CTEs down to ``sono(id, seg, b, c)`` from ``el(id, j, x)`` with 64 samples per id."""
    return f"""hn AS (SELECT n, 0.5 - 0.5 * cos(2 * pi() * n / 255) AS h FROM range(256) t(n)),
un AS (SELECT sum(h * h) AS u FROM hn),
cf AS (SELECT k, n % 64 AS j, sum(h * cos(2 * pi() * k * n / 256)) AS c, sum(h * sin(2 * pi() * k * n / 256)) AS s
       FROM hn, range(129) t(k) GROUP BY k, n % 64),
el AS ({samples}),
pw AS (SELECT id, k, (sum(x * c) ^ 2 + sum(x * s) ^ 2) * (0.0875 * 32768) ^ 2 / any_value(u) * CASE WHEN k = 0 THEN 1 ELSE 2 END / (2 * pi()) AS p
       FROM el JOIN cf USING (j), un GROUP BY id, k),
sg AS (SELECT * FROM (VALUES {segments}) t(seg, a)),
ed AS (SELECT * FROM (VALUES {_EDGES}) t(b, lo, hi)),
bk AS (SELECT i.id, b, coalesce(sum(p) FILTER (k * {RATE / 256!r} >= lo AND k * {RATE / 256!r} < hi), 0) AS p
       FROM pw i, ed GROUP BY i.id, b),
sp AS (SELECT x.id, seg, y.b, sum(x.p * a * 10 ^ ((15.81 + 7.5 * (y.b - x.b + 0.474) - 17.5 * sqrt(1 + (y.b - x.b + 0.474) ^ 2)) / 10)) AS p
       FROM bk x, ed y, sg GROUP BY x.id, seg, y.b),
db AS (SELECT id, seg, b, 10 * log10(greatest(p, 1)) AS d FROM sp),
cv AS (SELECT * FROM (VALUES {_CURVES}) t(b, n, d0, d1, p0, p1)),
ph AS (SELECT id, seg, b, coalesce(max(p0 + (d - d0) / (d1 - d0) * (p1 - p0)) FILTER (d > d0 AND (d <= d1 OR n = 5)), 3) AS p
       FROM db JOIN cv USING (b) GROUP BY id, seg, b),
sono AS (SELECT id, seg, b, CASE WHEN p >= 40 THEN 2 ^ ((p - 40) / 10) ELSE (p / 40) ^ 2.642 END AS c FROM ph)"""


_TWO = f"""WITH {TABLES_SQL}, {sonogram_sql("SELECT id, unnest(range(0, 64)) AS j, unnest(e) AS x FROM vec", "(0, 1.0), (1, 0.25)")}"""
_MOD = f", md AS (SELECT k, 1 / (k * {RATE} / 65536.0 / 4 + 4 / (k * {RATE} / 65536.0)) AS f FROM range(1, 61) t(k))"


def _feature(name: str, sql: str, digits: int = DIGITS):
    @register(f"signal_{name}", sql)
    def run(spark, sf_dir):
        tables = extract_from_waveforms(waveforms(spark, sf_dir), [name])
        return tables[name].select("id", _text(name, digits).alias(name), F.size(name).alias("dim"))


_SSD_PARTS = """, st AS (SELECT id, seg, part, b, CASE WHEN part IN (0, 4, 5, 6) THEN c ELSE 0 END AS v FROM sono, range(7) t(part))"""

_feature("rp", _TWO + _MOD + f", m AS (SELECT id, b, avg(c) AS c FROM sono GROUP BY id, b) SELECT id, {_agg_text('c * f / 256', 'k, b')} AS rp, 1440 AS dim FROM m, md GROUP BY id")
_feature("rh", _TWO + _MOD + f", m AS (SELECT id, sum(c) / 2 / 256 AS c FROM sono GROUP BY id) SELECT id, {_agg_text('c', 'k')} AS rh, 60 AS dim FROM m, md GROUP BY id")
_feature("ssd", _TWO + _SSD_PARTS + f", m AS (SELECT id, part, b, avg(v) AS v FROM st GROUP BY ALL) SELECT id, {_agg_text('v', 'part, b')} AS ssd, 168 AS dim FROM m GROUP BY id")

_MVD = """, s1 AS (SELECT id, seg, avg(c) AS mean, var_pop(c) AS var, median(c) AS median, min(c) AS min, max(c) AS max FROM (SELECT id, seg, c / 256 AS c FROM sono) GROUP BY id, seg),
s2 AS (SELECT id, seg, any_value(s1.mean) AS mean, any_value(s1.var) AS var, any_value(s1.median) AS median, any_value(s1.min) AS min, any_value(s1.max) AS max,
  CASE WHEN any_value(s1.var) > 1e-24 THEN avg((c / 256 - s1.mean) ^ 3) / any_value(s1.var) ^ 1.5 ELSE 0 END AS skew,
  CASE WHEN any_value(s1.var) > 1e-24 THEN avg((c / 256 - s1.mean) ^ 4) / any_value(s1.var) ^ 2 ELSE 0 END AS kurtosis
  FROM sono JOIN s1 USING (id, seg) GROUP BY id, seg),
mp AS (""" + " UNION ALL ".join(
    f"SELECT id, {n} AS part, avg({c}) AS v FROM s2 GROUP BY id"
    for n, c in enumerate(("mean", "var", "skew", "kurtosis", "median", "min", "max"))
) + ")"
_feature("mvd", _TWO + _MOD + _MVD + f" SELECT id, {_agg_text('v', 'part, k')} AS mvd, 420 AS dim FROM mp, md GROUP BY id")

_OVER_SEGMENTS = """, t AS (SELECT id, {pos}, avg(v) AS mean, var_pop(v) AS var, min(v) AS lo, max(v) AS hi FROM {src} GROUP BY id, {pos}),
q AS (SELECT id, {pos}, part7, CASE part7 WHEN 0 THEN mean WHEN 1 THEN var WHEN 2 THEN 0 WHEN 3 THEN CASE WHEN var > 0 THEN 1 ELSE 0 END
  WHEN 4 THEN mean WHEN 5 THEN lo ELSE hi END AS w FROM t, range(7) r(part7))"""
_feature("tssd", _TWO + _SSD_PARTS + _OVER_SEGMENTS.format(pos="part, b", src="st") + f" SELECT id, {_agg_text('w', 'part7, part, b')} AS tssd, 1176 AS dim FROM q GROUP BY id")
_feature(
    "trh",
    _TWO + _MOD + ", hs AS (SELECT id, seg, k, c AS v FROM (SELECT id, seg, sum(c) / 256 AS c FROM sono GROUP BY id, seg), md)"
    + _OVER_SEGMENTS.format(pos="k", src="hs").replace("WHEN var > 0 THEN 1", "WHEN var > 0 THEN 1")
    + f" SELECT id, {_agg_text('w', 'part7, k')} AS trh, 420 AS dim FROM q GROUP BY id",
)


@register(
    "segment_signal",
    f"""WITH {TABLES_SQL} SELECT id, seg AS seg_no, seg * 65536 AS start, 65536 AS n, round(list_sum(e) * 1024 / (seg + 1), 4) AS total
FROM vec, range(2) t(seg)""",
)
def segment_signal_query(spark, sf_dir):
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    cut = segment_signal(waveforms(spark, sf_dir))
    return cut.select("id", "seg_no", "start", F.size("samples").alias("n"), F.round(total, 4).alias("total"))


@register("segment_errors", f"WITH {TABLES_SQL} SELECT id, 'not enough data: 64 samples' AS error FROM vec")
def segment_errors_query(spark, sf_dir):
    short = vectors(spark, sf_dir).select("id", F.lit(RATE).alias("sample_rate"), F.col("e").alias("samples"))
    return segment_errors(short)


@register(
    "segment_feature_rows",
    _TWO + _MOD + f""", h AS (SELECT id, seg, sum(c) / 256 AS c FROM sono GROUP BY id, seg)
SELECT id, seg AS seg_no, seg * 65536 + 1 AS first_sample, (seg + 1) * 65536 AS last_sample, round((seg * 65536 + 1) / {RATE}.0, 6) AS first_second,
  {_agg_text('c', 'k')} AS rh FROM h, md GROUP BY id, seg""",
)
def segment_feature_rows(spark, sf_dir):
    rows = with_time(extract_from_waveforms(waveforms(spark, sf_dir), ["rh"], segments_only=True))
    return rows.select(
        "id", "seg_no", "first_sample", "last_sample", F.round("first_second", 6).alias("first_second"), _text("vec").alias("rh")
    )


@register(
    "signal_options",
    _TWO
    + """, sp12 AS (SELECT x.id, seg, y.b, sum(x.p * a * 10 ^ ((15.81 + 7.5 * (y.b - x.b + 0.474) - 17.5 * sqrt(1 + (y.b - x.b + 0.474) ^ 2)) / 10)) AS p
  FROM bk x, ed y, sg WHERE x.b < 12 AND y.b < 12 GROUP BY x.id, seg, y.b),
v12 AS (SELECT id, part, b, avg(CASE WHEN part IN (0, 4, 5, 6) THEN 10 * log10(greatest(p, 1)) ELSE 0 END) AS v FROM sp12, range(7) t(part) GROUP BY id, part, b)"""
    + f" SELECT id, 360 AS rp_dim, 84 AS ssd_dim, {_agg_text('v', 'part, b', 3)} AS ssd FROM v12 GROUP BY id",
)
def signal_options(spark, sf_dir):
    """Twelve bands, thirty modulation bins, no loudness transforms."""
    options = RhythmOptions(n_bark_bands=12, mod_ampl_limit=30, phon=False, sone=False, fluctuation_weighting=False)
    tables = extract_from_waveforms(waveforms(spark, sf_dir), ["rp", "ssd"], options)
    both = tables["rp"].join(tables["ssd"], "id")
    return both.select("id", F.size("rp").alias("rp_dim"), F.size("ssd").alias("ssd_dim"), _text("ssd", 3).alias("ssd"))


# --- loudness steps as column expressions ---------------------------------------------------

_DB = ", ".join(f"round(10 * log10(greatest(abs(e[{b + 1}]) * {10 ** (b % 8)}.0, 1)), 6) AS db{b}" for b in range(24))


@register("to_db", f"WITH {TABLES_SQL} SELECT id, {_DB} FROM vec")
def to_db(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        "id", *[F.round(S.to_db(F.abs(F.col("e")[b]) * float(10 ** (b % 8))), 6).alias(f"db{b}") for b in range(24)]
    )


_PHON_SONE = f"""WITH {TABLES_SQL}, x AS (SELECT id, unnest(range(0, 24)) AS b, unnest(list_transform(e[1:24], lambda v: abs(v) * 300)) AS d FROM vec),
cv AS (SELECT * FROM (VALUES {_CURVES}) t(b, n, d0, d1, p0, p1)),
ph AS (SELECT id, b, coalesce(max(p0 + (d - d0) / (d1 - d0) * (p1 - p0)) FILTER (d > d0 AND (d <= d1 OR n = 5)), 3) AS p FROM x JOIN cv USING (b) GROUP BY id, b)"""


@register("to_phon", _PHON_SONE + f" SELECT id, {_agg_text('p', 'b', 6)} AS phon FROM ph GROUP BY id")
def to_phon(spark, sf_dir):
    levels = F.array(*[S.to_phon(F.abs(F.col("e")[b]) * 300, b) for b in range(24)])
    return vectors(spark, sf_dir).select("id", _text(levels, 6).alias("phon"))


@register(
    "to_sone",
    _PHON_SONE + f" SELECT id, {_agg_text('CASE WHEN p >= 40 THEN 2 ^ ((p - 40) / 10) ELSE (p / 40) ^ 2.642 END', 'b', 6)} AS sone FROM ph GROUP BY id",
)
def to_sone(spark, sf_dir):
    levels = F.array(*[S.to_sone(S.to_phon(F.abs(F.col("e")[b]) * 300, b)) for b in range(24)])
    return vectors(spark, sf_dir).select("id", _text(levels, 6).alias("sone"))


# --- WAV files: one 8-bit mono file per vector, built in Spark --------------------------------


def wav_header(n_samples: int, rate: int = RATE) -> bytes:
    """RIFF header of 8-bit mono."""
    import struct

    chunk = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + n_samples, b"WAVE") + chunk + struct.pack("<4sI", b"data", n_samples)


def wav_files(spark, sf_dir, repeat: int = 1, rows=None):
    """``(id, content)`` of the vectors, or of ``rows`` with more columns, which are kept."""
    levels = F.transform("e", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round(x * 100) + 128)).cast("long")), 2, "0"))
    data = F.unhex(F.repeat(F.array_join(levels, ""), repeat))
    rows = spread_small(vectors(spark, sf_dir).select("id", "e")) if rows is None else rows
    return rows.withColumn("content", F.concat(F.lit(wav_header(64 * repeat)), data)).drop("e")


def labelled_files(spark, sf_dir):
    """``(folder, name, content)`` of WAV files; labels join the vectors, not the files made of them."""
    labels = vectors(spark, sf_dir).select("id", F.concat(F.lit("tone"), "label").alias("folder"))
    rows = vectors(spark, sf_dir).select("id", "e").join(labels, "id").repartition(4 * spark.sparkContext.defaultParallelism)
    files = wav_files(spark, sf_dir, 1024, rows)
    return files.select("folder", F.concat_ws("/", "folder", F.concat("id", F.lit(".wav"))).alias("name"), "content")


_LEVEL = "greatest(0, least(255, round(v * 100) + 128))"


@register(
    "decode_wav",
    f"""WITH {TABLES_SQL} SELECT id AS path, {RATE} AS sample_rate, 1 AS sample_width, 1 AS n_channels, 64 AS n_samples,
  array_to_string(list_transform(e, lambda v: CAST({_LEVEL} AS INTEGER)), ',') AS samples FROM vec""",
)
def decode_wav_query(spark, sf_dir):
    waves = decode_wav(wav_files(spark, sf_dir).withColumnRenamed("id", "path"))
    values = F.transform("samples", lambda s: s[0].cast("int").cast("string"))
    return waves.select("path", "sample_rate", "sample_width", "n_channels", "n_samples", F.array_join(values, ",").alias("samples"))


@register(
    "audit",
    f"""WITH {TABLES_SQL} SELECT id AS filename, 'decoded' AS outcome, 8 AS sample_bits, 64 AS n_samples FROM vec
UNION ALL SELECT 'doc' || doc_id, 'failed', NULL, NULL FROM documents""",
)
def audit_query(spark, sf_dir):
    """Good and broken files in one job: the log of the first, the errors of the others."""
    broken = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("path"), F.encode("text", "utf-8").alias("content")
    )
    files = wav_files(spark, sf_dir).withColumnRenamed("id", "path").unionByName(broken)
    good, bad = audit(decode_wav(files))
    decoded = good.select("filename", F.lit("decoded").alias("outcome"), "sample_bits", "n_samples")
    return decoded.unionByName(bad.select("filename", F.lit("failed").alias("outcome")), allowMissingColumns=True)


_FILE = f"""WITH {TABLES_SQL}, {sonogram_sql(f"SELECT id, unnest(range(0, 64)) AS j, unnest(list_transform(e, lambda v: {_LEVEL} / 128.0)) AS x FROM vec", "(0, 1.0)")}"""


@register(
    "file_features",
    _FILE + _MOD + f", m AS (SELECT id, sum(c) / 256 AS c FROM sono GROUP BY id) SELECT id, {_agg_text('c', 'k')} AS rh FROM m, md GROUP BY id",
)
def file_features(spark, sf_dir):
    raw = materialize(X.file_features(wav_files(spark, sf_dir, 1024), ["rh"]), "file-features", SEGMENT_ROWS)
    return X.feature_tables(raw, ["rh"])["rh"].select("id", _text("rh").alias("rh"))


@register(
    "stored_segments",
    _TWO + _MOD + f", m AS (SELECT id, sum(c) / 2 / 256 AS c FROM sono GROUP BY id) SELECT id, {_agg_text('c', 'k')} AS rh FROM m, md GROUP BY id",
)
def stored_segments(spark, sf_dir):
    """Aggregates of a stored table of segment features, where no task has a whole song."""
    segments = extract_from_waveforms(waveforms(spark, sf_dir), ["rh"], segments_only=True)
    return aggregate_features(segments, ["rh"])["rh"].select("id", _text("rh").alias("rh"))


def write_files(files, folder: str):
    """``(name, content)`` rows as files below a shared folder, each complete or not there."""

    def put(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = f"{root}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{path}.part", compression=None) as out:
                    out.write(content.as_buffer())
                store.move(f"{path}.part", path)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return files.select("name", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0]


@register(
    "extract_job",
    _FILE + _MOD + f", m AS (SELECT id, sum(c) / 256 AS c FROM sono GROUP BY id) SELECT id || '.wav' AS id, 'tone' || CAST(label AS VARCHAR) AS id2, {_agg_text('c', 'k')} AS rh"
    " FROM m JOIN (SELECT id, label FROM vec) USING (id), md GROUP BY id, label",
)
def extract_job(spark, sf_dir):
    """Files on disk to a feature CSV with labels: first a part, then what is new, then nothing."""
    stub = scratch_path(spark, "extract")
    files = labelled_files(spark, sf_dir)
    early = F.col("folder") == "tone1"
    for some in (files.where(early), files.where(~early), None):
        if some is not None:
            write_files(some, f"{stub}/media")
        X.extract_features(spark, f"{stub}/media", ["rh"], f"{stub}/out", append_new=True, label=True)
    read = read_features_csv(spark, f"{stub}/out.rh", [0, 1])
    return read.select(F.substring_index("id", "/", -1).alias("id"), "id2", _text("vec").alias("rh"))


@register("decode_errors", "SELECT 'doc' || doc_id AS id, true AS failed FROM documents")
def decode_errors(spark, sf_dir):
    """Documents are no WAV files: every one ends in the error rows."""
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("id"), F.encode("text", "utf-8").alias("content")
    )
    return file_segment_features(files, ["rh"]).select("id", F.col("error").isNotNull().alias("failed"))


@register(
    "extract_stream",
    _FILE + _MOD + f", m AS (SELECT id, sum(c) / 256 AS c FROM sono GROUP BY id) SELECT id || '.wav' AS id, 'tone' || CAST(label AS VARCHAR) AS id2, {_agg_text('c', 'k')} AS rh, NULL AS failed"
    " FROM m JOIN (SELECT id, label FROM vec) USING (id), md GROUP BY id, label UNION ALL SELECT source || '.wav', NULL, NULL, true FROM documents GROUP BY source",
)
def extract_stream_query(spark, sf_dir):
    """Files arrive in three lots, broken ones among them; every file is read in one run only."""
    root = scratch_path(spark, "stream")
    files = labelled_files(spark, sf_dir)
    broken = table(spark, sf_dir, "documents").groupBy("source").agg(F.encode(F.min("text"), "utf-8").alias("content"))
    broken = broken.select(F.concat(F.lit("texts/"), "source", F.lit(".wav")).alias("name"), "content")
    early = F.col("folder") == "tone1"
    for some in (files.where(early), files.where(~early), broken):
        write_files(some, f"{root}/media")
        extract_stream(spark, f"{root}/media", f"{root}/table", f"{root}/checkpoint", ["rh"]).awaitTermination()
    found = streamed_features(spark, f"{root}/table", ["rh"], label=True)
    good = found["rh"].select(F.substring_index("id", "/", -1).alias("id"), "id2", _text("rh").alias("rh"))
    return good.unionByName(found["errors"].select(F.substring_index("id", "/", -1).alias("id"), F.lit(True).alias("failed")), allowMissingColumns=True)
