"""Frames, beats and keys of tones, clicks and chords made from the given vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from echorank.functions.arrow import WAVES, wave_batch
from echorank.functions.pitch import PITCHES
from echorank.functions.spectral import CEPSTRA, cosine_matrix, mel_matrix
from echorank.operators.models import gaussian_model
from echorank.plans import frames as A
from echorank.session import SEGMENT_ROWS, materialize, spread_small

from .catalogue import TABLES_SQL, vectors
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

RATE, SIZE = 11025, 512
OPTIONS = A.FrameOptions(rate=RATE, cepstra=(SIZE, SIZE // 2), chroma=(2048, 1024), onsets=(256, 128))


def _frames(waves, kind, options=OPTIONS):
    return materialize(A.recording_frames(waves, [kind], options), "frames", SEGMENT_ROWS)


def _waves(spark, sf_dir, seconds, sample, of, rate=None):
    """``(id, sample_rate, samples)`` with ``sample(seconds, of)`` of each vector's row.

    ``of`` are the numbers a row's sound is made of; its samples are computed at once.
    """

    def sound(batches):
        for batch in batches:
            for name, rate, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                known = rate is not None and None not in numbers
                row = sample(np.arange(int(rate * seconds)) / rate, *numbers) if known else None
                yield wave_batch(name, rate, pa.array(row) if known else None)

    rate = F.lit(RATE) if rate is None else rate
    numbers = F.array(*[c.cast("double") for c in of])
    rows = spread_small(vectors(spark, sf_dir))
    return rows.select("id", rate.cast("int").alias("sample_rate"), numbers.alias("of")).mapInArrow(sound, WAVES)


def _weights(matrix) -> str:
    return ", ".join(f"({i}, {j}, {float(v)!r}::DOUBLE)" for i, row in enumerate(matrix) for j, v in enumerate(row) if v)


# All frames of a vector repeated see the same 64 numbers, so a bin of the spectrum is their
# product with the window's 64 folded sums.
_CEPSTRA_SQL = f"""WITH {TABLES_SQL}, el AS (SELECT id, unnest(range(64)) AS j, unnest(e) AS x FROM vec),
win AS (SELECT n, 0.54 - 0.46 * cos(2 * pi() * n / {SIZE - 1}) AS w FROM range({SIZE}) t(n)),
fold AS (SELECT k, n % 64 AS j, sum(w * cos(2 * pi() * k * n / {SIZE})) AS re, sum(w * sin(2 * pi() * k * n / {SIZE})) AS im
         FROM win, range({SIZE // 2 + 1}) b(k) GROUP BY k, n % 64),
power AS (SELECT id, k, (sum(x * re) ^ 2 + sum(x * im) ^ 2) * (2 / (SELECT sum(w) FROM win)) ^ 2 AS p FROM el JOIN fold USING (j) GROUP BY id, k),
mel(b, k, w) AS (VALUES {_weights(mel_matrix(SIZE, RATE))}),
level AS (SELECT id, b, 10 * log10(greatest(sum(p * w), 1e-10)) AS l FROM power JOIN mel USING (k) GROUP BY id, b),
turn(c, b, w) AS (VALUES {_weights(cosine_matrix(40, CEPSTRA))}),
cep AS (SELECT id, c, sum(l * w) AS v FROM level JOIN turn USING (b) GROUP BY id, c)
"""


@register("mel_cepstra", _CEPSTRA_SQL + "SELECT id, CAST(c AS INTEGER) AS coefficient, 7 AS frames, round(v, 4) + 0.0 AS mean FROM cep")
def mel_cepstra(spark, sf_dir):
    """Cepstra of tones of period 64, and their mean in the timbre model."""
    tones = vectors(spark, sf_dir).select("id", F.lit(RATE).alias("sample_rate"), F.flatten(F.array_repeat("e", 32)).alias("samples"))
    frames = A.of_kind(_frames(spread_small(tones), "cepstra"), "cepstra")
    counts = frames.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("frames"))
    model = gaussian_model(frames, CEPSTRA).select("id", F.posexplode("mean").alias("coefficient", "m"))
    return model.join(counts, "id").select("id", "coefficient", "frames", (F.round("m", 4) + 0.0).alias("mean"))


@register("resampled_tones", f"WITH {TABLES_SQL} SELECT id, CAST(vec_id % 12 AS INTEGER) AS pitch, true AS clear FROM vec")
def resampled_tones(spark, sf_dir):
    """Tones recorded at four sampling rates keep their pitch at a fifth one."""
    rate = F.element_at(F.array(*map(F.lit, (8000, 16000, 32000, 48000))), (F.col("vec_id") % 4 + 1).cast("int"))
    hertz = F.lit(440.0) * F.pow(F.lit(2.0), (F.col("vec_id") % 12) / 12)
    waves = _waves(spark, sf_dir, 1, lambda t, hertz: np.sin(2 * np.pi * hertz * t) / 2, [hertz], rate)
    frames = A.of_kind(_frames(waves, "chroma"), "chroma")
    means = frames.groupBy("id").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(12)]).alias("m"))
    top = F.array_max("m")
    others = F.array_max(F.transform("m", lambda v: F.when(v < top, v).otherwise(0.0)))
    return means.select("id", (F.array_position("m", top) - 1).cast("int").alias("pitch"), (others < top / 4).alias("clear"))


_KEYS = "[" + ", ".join(f"'{p}'" for p in PITCHES) + "]"


@register("keys_of_chords", f"WITH {TABLES_SQL} SELECT id, ({_KEYS})[vec_id % 12 + 1] AS key, CASE WHEN vec_id // 12 % 2 = 0 THEN 'major' ELSE 'minor' END AS scale FROM vec")
def keys_of_chords(spark, sf_dir):
    """Cadences (tonic, fourth, fifth, tonic) in all keys."""
    minor = F.floor(F.col("vec_id") / 12) % 2 == 1

    def sample(t, key, minor):
        # quarters of a second: steps of the roots above the key
        root = np.array([0, 5, 7, 0])[np.floor(t * 4).astype(int) % 4]
        third = np.where((minor > 0) & (root != 7), 3, 4)
        tones = [np.sin(2 * np.pi * 220.0 * 2.0 ** ((key + root + step) / 12) * t) for step in (0, third, 7)]
        return (tones[0] + tones[1] + tones[2]) / 4

    waves = _waves(spark, sf_dir, 1, sample, [F.col("vec_id") % 12, minor])
    return A.item_keys(_frames(waves, "chroma")).select("id", "key", "scale")


@register("tempo_of_clicks", f"WITH {TABLES_SQL} SELECT id, 60 + vec_id % 120 AS bpm, true AS near, true AS steady FROM vec")
def tempo_of_clicks(spark, sf_dir):
    """Clicks of known tempo: the tempo found, and the steps between the beats."""
    planted = 60 + F.col("vec_id") % 120
    waves = _waves(spark, sf_dir, 12, lambda t, bpm: np.exp(-np.fmod(t, 60 / bpm) * 60) * np.sin(2 * np.pi * 1500 * t), [planted])
    beats = A.item_beats(_frames(waves, "onsets"), OPTIONS).withColumnRenamed("bpm", "found")
    bpm = 60 + F.substring("id", F.lit(5), F.length("id")).cast("long") % 120
    # A tempo counts as found at half or twice the clicks too, as it does for listeners.
    octave = F.round(F.log2(F.col("found") / bpm))
    close = (F.abs(F.col("found") / bpm / F.pow(F.lit(2.0), octave) - 1) < 0.02) & (F.abs(octave) <= 1)
    steps = F.transform(F.slice("beats", F.lit(2), F.greatest(F.size("beats") - 1, F.lit(1))), lambda b, i: b - F.get("beats", i))
    even = F.forall(steps, lambda s: F.abs(s * F.col("found") / 60 - 1) < 0.1) & (F.size("beats") > 4)
    return beats.select("id", bpm.alias("bpm"), close.alias("near"), even.alias("steady"))
