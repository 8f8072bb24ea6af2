"""Column expressions with hand-computed rows."""

import pytest
from pyspark.sql import functions as F

from echorank.functions import ids, loudness, pitch, vectors
from echorank.functions.distances import euclidean, levenshtein


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(values):
    return F.array(*[F.lit(v) for v in values])


def test_ids(spark):
    assert one(spark, ids.normalize_id(F.lit("a b/c; d.e, f[1].mp3"))) == "ab/cdef[1]mp3"
    assert one(spark, ids.normalize_id(F.lit("a [b].mp3"), strip_brackets=True)) == "abmp3"
    assert ids.normalize_id_text("a b/c; d.e, f[1].mp3") == "ab/cdef[1]mp3"
    assert one(spark, ids.file_id(F.lit("Aura/x. y.mp3"))) == "Aura/x y.mp3"
    assert one(spark, ids.file_id(F.lit("haus.aiff"), compat=True)) == "h.aus..aiff"
    assert one(spark, ids.repair_delimiter(F.lit("a;b.mp3; [1, 2]"))) == "a,b.mp3;[1,2]"
    assert one(spark, ids.class_label(F.lit("music/Rock/x.mp3"))) == "Rock"
    assert one(spark, ids.class_label(F.lit("x.mp3"))) is None
    assert one(spark, ids.class_label(F.lit("pop.0001.wav"), "prefix")) == "pop"
    with pytest.raises(ValueError):
        ids.class_label("x", "shape")


def test_vectors(spark):
    assert one(spark, vectors.parse_vector(F.lit("[0., 1.5,[2e1]]"))) == [0.0, 1.5, 20.0]
    assert one(spark, vectors.parse_vector(F.lit("[0., x]"))) is None
    assert one(spark, vectors.format_vector(lit([0.5, 1e-5]))) == "[0.50000000,0.00001000]"
    assert one(spark, vectors.format_matrix(lit([1.0, 2.0, 3.0, 4.0]), 2, 1)) == "[[1.0,2.0],[3.0,4.0]]"
    assert one(spark, vectors.matrix_order(lit([0.0] * 182))) == 13
    assert one(spark, vectors.upper_triangle(lit([float(v) for v in range(9)]), 3)) == [0, 1, 2, 4, 5, 8]
    assert len(one(spark, vectors.euclidean_model_vector(lit([0.0] * 182)))) == 104


def test_pitches(spark):
    assert one(spark, pitch.encode_pitches(F.lit(" [10, 11, 0, 1, 9]"))) == "[KLABJ]"
    assert one(spark, pitch.encode_pitch_array(lit([0, 11, 9]))) == "ALJ"
    assert one(spark, pitch.transpose_notes(F.lit("B"), lit([0, 2, 11]))) == [10, 0, 9]
    assert one(spark, pitch.transpose_notes(F.lit("A"), lit([3]))) == [3]
    rows = [float(v) for v in range(24)]
    moved = one(spark, pitch.transpose_chroma(F.lit("Bb"), lit(rows)))
    assert moved == rows[2:] + rows[:2]
    with pytest.raises(Exception, match="unknown key: H"):
        one(spark, pitch.key_index(F.lit("H")))


def test_distances(spark):
    assert one(spark, euclidean(lit([0.0, 3.0]), lit([4.0, 0.0]))) == 5.0
    assert one(spark, levenshtein(F.lit("[ABC]"), F.lit("[ACD]"))) == 2


def test_loudness_reference_values(spark):
    db = one(spark, loudness.to_db(F.lit(12978.051641)))
    assert db == pytest.approx(41.13209498, abs=1e-7)
    phon = one(spark, loudness.to_phon(F.lit(41.13209498), 0))
    assert phon == pytest.approx(25.90299283, abs=1e-7)
    assert one(spark, loudness.to_sone(F.lit(25.90299283))) == pytest.approx(0.31726931, abs=1e-7)
    assert one(spark, loudness.to_sone(F.lit(47.03087564))) == pytest.approx(1.62798518, abs=1e-7)
    assert one(spark, loudness.to_db(F.lit(0.0))) == 0.0
    assert one(spark, loudness.to_phon(F.lit(-3.0), 5)) == 3.0


def test_pcm(spark):
    stereo = F.array(lit([16384.0, 0.0]), lit([-32768.0, 32768.0]))
    scaled = loudness.normalize_pcm(stereo, F.lit(2))
    assert one(spark, scaled) == [[0.5, 0.0], [-1.0, 1.0]]
    assert one(spark, loudness.to_mono(scaled)) == [0.25, 0.0]
    assert one(spark, loudness.normalize_pcm(F.array(lit([255.0])), F.lit(1)))[0][0] == pytest.approx(255 / 128)
