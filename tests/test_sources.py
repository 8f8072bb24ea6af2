"""Feature text files, tables, ARFF, media."""

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from echorank.operators.integrity import (
    check_duplicates,
    check_id_consistency,
    order_consistency,
    select_ids_ordered,
)
from echorank.plans.ranking import rank_full
from echorank.sinks import columnar, text
from echorank.sources import lines, media, tables


def df_of(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_chroma_lines(spark):
    got = lines.parse_chroma(
        df_of(spark, "music/Foo bar.mp3; [[0.1,0. ],[1. ,0.5]]", "music/x.mp3; []", "music/x.mp3; [[nan,1]]", "music/y.mp3")
    ).collect()
    assert [(r.id, r.chroma) for r in got] == [("music/Foobarmp3", [0.1, 0.0, 1.0, 0.5])]


def test_beat_and_note_lines(spark):
    bh = lines.parse_beat_histogram(df_of(spark, "music/x.mp3; 120.5; [0., 1., 2.]", "bad; x; [1, y]"))
    assert bh.first().asDict() == {"id": "music/xmp3", "bpm": 120.5, "bh": [0.0, 1.0, 2.0]}
    good, bad = lines.split_malformed(bh, "bpm", "bh")
    assert good.count() == 1 and bad.first().id == "bad"
    notes = lines.parse_notes(df_of(spark, "music/x.mp3; A#; minor; [10, 11, 0, 1, 9]")).first()
    assert (notes.id, notes.key, notes.scale, notes.notes) == ("music/xmp3", "A#", "minor", "[KLABJ]")


def test_vector_lines(spark):
    assert lines.parse_vector_csv(df_of(spark, "a b.mp3,1.5,2"), "rp").first().rp == [1.5, 2.0]
    row = lines.parse_vector_csv_bracketed(df_of(spark, "a, b.mp3; [1.5, 2]"), "rp").first()
    assert (row.id, row.rp) == ("abmp3", [1.5, 2.0])
    model = lines.parse_mfcc_model(df_of(spark, f"a.mp3; {[1.0] * 13}; {[[0.5] * 13] * 13}", "b.mp3; [1,2]; [3]"))
    assert [(r.id, r.mfcc and len(r.mfcc)) for r in model.collect()] == [("amp3", 182), ("bmp3", None)]
    stats = lines.parse_mfcc_statistics(df_of(spark, "a.mp3; [1]; [2]; [3,4]")).first()
    assert (stats.mean, stats["var"], stats.cov_ut) == ([1.0], [2.0], [3.0, 4.0])
    assert lines.parse_manifest(df_of(spark, "a b.mp3     :       17")).first().asDict() == {"id": "a b.mp3", "part": 17}


def test_files_to_ranking(spark, tmp_path):
    """Feature files of every family, written, found by pattern, ranked."""
    rng = np.random.default_rng(2)
    for part in range(2):
        folder = tmp_path / f"features{part + 1}"
        folder.mkdir()
        names = [f"music/{part} song {n}.mp3" for n in range(4)]
        write = lambda ext, rows: (folder / f"out{part}.{ext}").write_text("\n".join(rows) + "\n")
        vec = lambda n: ",".join(f"{v:.8f}" for v in rng.random(n))
        write("rp", [f"{i},{vec(1440)}" for i in names])
        write("rh", [f"{i},{vec(60)}" for i in names])
        write("bh", [f"{i}; 120.0; [{vec(250)}]" for i in names])
        write("notes", [f"{i}; A; major; {[int(v) for v in rng.integers(0, 12, 9)]}" for i in names])
        write("chroma", [f"{i}; [{','.join('[' + vec(7 + n) + ']' for _ in range(12))}]" for n, i in enumerate(names)])
        models = [np.cov(rng.normal(size=(13, 40))) for _ in names]
        write("mfcckl", [f"{i}; [{vec(13)}]; {str(m.tolist())}" for i, m in zip(names, models)])
    catalogue = lines.read_catalogue(spark, str(tmp_path))
    ranked = rank_full(catalogue, "music/1 song 2.mp3")
    assert ranked.count() == 8
    assert ranked.where("scaled_rp = 0").first().id == "music/1song2mp3"


def test_features_csv_columns(spark, tmp_path):
    (tmp_path / "f.csv").write_text('"a, b",x,1,2\n"say ""hi""",y,3,4.5\n')
    path = str(tmp_path / "f.csv")
    two = tables.read_features_csv(spark, path, [0, 1]).collect()
    assert [(r.id, r.id2, r.vec) for r in two] == [("a, b", "x", [1.0, 2.0]), ('say "hi"', "y", [3.0, 4.5])]
    assert tables.read_features_csv(spark, path, [-1, 1], ids_only=True).first().id == "2"
    assert tables.read_features_csv(spark, path, separate_ids=False).first().vec == ["a, b", "x", "1", "2"]


def test_integrity_checks(spark, tmp_path):
    a = spark.createDataFrame([("x", [1.0]), ("y", [2.0])], "id string, rp array<double>")
    b = spark.createDataFrame([("x", [1.0]), ("z", [2.0])], "id string, rh array<double>")
    text.write_features_csv({"rp": a, "rh": b}, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="not matching"):
        tables.read_feature_set(spark, str(tmp_path / "s"), ["rp", "rh"])
    check_id_consistency({"rp": a})
    with pytest.raises(ValueError, match="duplicate ids: x"):
        check_duplicates(a.union(a.where("id = 'x'")))
    with pytest.warns(UserWarning, match="duplicate ids"):
        check_duplicates(a.union(a), raise_error=False)
    forward = spark.createDataFrame([(0, "x"), (1, "y")], "position int, id string")
    backward = spark.createDataFrame([(0, "y"), (1, "x")], "position int, id string")
    assert order_consistency({"a": forward, "b": backward}).count() == 4
    assert order_consistency({"a": forward, "b": forward}).count() == 0
    assert [r.id for r in select_ids_ordered(a, ["y", "x", "y"]).collect()] == ["y", "x", "y"]


def test_columnar(spark, tmp_path):
    stub = str(tmp_path / "c")
    a = spark.createDataFrame([("x", [1.1]), ("y", [2.0])], "id string, rp array<double>")
    columnar.write_columnar({"rp": a}, stub, float32=True, rows_per_file=1)
    assert dict(spark.read.parquet(f"{stub}.rp.parquet").dtypes)["rp"] == "array<float>"
    assert columnar.read_columnar(spark, stub, "rp", ids_only=True)["rp"].columns == ["id"]
    gap = spark.createDataFrame([("x", [1.1]), ("y", None)], "id string, rp array<double>")
    columnar.write_columnar({"rp": gap}, stub)
    with pytest.raises(ValueError, match="does not match"):
        columnar.read_columnar(spark, stub, "rp")
    with pytest.raises(ValueError, match="no single dimension"):
        text.write_features_csv({"rp": spark.createDataFrame([("x", [1.0]), ("y", [1.0, 2.0])], "id string, rp array<double>")}, stub)


def test_arff_quoting(spark, tmp_path):
    frame = spark.createDataFrame([(1.5, 'a, "b"', "pop"), (2.0, "c", "rock")], "feat0 double, ID string, class string")
    text.write_arff(frame, str(tmp_path / "x.arff"), "x")
    whole = "\n".join(r.value for r in spark.read.text(str(tmp_path / "x.arff")).collect())
    assert "@Attribute class {pop,rock}" in whole and "@Attribute feat0 numeric" in whole
    got = {r.id: (r.vec, r["class"]) for r in tables.read_arff(spark, str(tmp_path / "x.arff")).collect()}
    assert got == {'a, "b"': ([1.5], "pop"), "c": ([2.0], "rock")}


def test_encoded_csv(spark, tmp_path):
    df = spark.createDataFrame([("é", None), ("ß", "x")], "a string, b string")
    path = str(tmp_path / "e")
    text.write_csv_encoded(df, path, encoding="iso-8859-1", header=True)
    back = tables.read_csv_encoded(spark, path, "iso-8859-1", header=True)
    assert {(r.a, r.b) for r in back.collect()} == {("é", None), ("ß", "x")}
    with pytest.raises(Exception, match="has more than"):
        (tmp_path / "long.csv").write_text("abcdef,1\n")
        tables.read_csv_encoded(spark, str(tmp_path / "long.csv"), max_field_size=5).collect()
    with pytest.raises(ValueError, match="outside the target"):
        text.write_csv_encoded(df, path, ["a"])
    text.write_csv_encoded(df, path, ["a"], extras="ignore")


def wav_bytes(rate, width, channels, frames):
    out = io.BytesIO()
    with wave.open(out, "wb") as wav:
        wav.setnchannels(channels), wav.setsampwidth(width), wav.setframerate(rate)
        wav.writeframes(frames)
    return out.getvalue()


def test_pcm_widths():
    assert media.decode_pcm(wav_bytes(8000, 1, 1, bytes([0, 255])))[2].tolist() == [[0], [255]]
    assert media.decode_pcm(wav_bytes(8000, 2, 2, struct.pack("<4h", 1, -1, 2, -2)))[2].tolist() == [[1, -1], [2, -2]]
    assert media.decode_pcm(wav_bytes(8000, 3, 1, b"\xff\xff\xff\x01\x00\x80"))[2].tolist() == [[-1], [-(2**23) + 1]]
    assert media.decode_pcm(wav_bytes(8000, 4, 1, struct.pack("<i", -5)))[2].tolist() == [[-5]]
    with pytest.raises(ValueError, match="empty"):
        media.decode_pcm(b"")


def test_scan_decode_and_audit(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.WAV").write_bytes(wav_bytes(11025, 2, 2, struct.pack("<4h", 1, 3, 2, 4)))
    (tmp_path / "b.wav").write_bytes(b"no wave")
    (tmp_path / ".hidden.wav").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"text")
    found = {r.path for r in media.scan_media(spark, str(tmp_path), relative=True).collect()}
    assert found == {"sub/a.WAV", "b.wav"}
    assert {r.path for r in media.scan_media(spark, str(tmp_path), types=None).collect()} >= {str(tmp_path / "c.txt")}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    good, bad = text.audit(media.decode_wav(files.where("path like '%.WAV' or path like '%b.wav'")))
    row = good.first()
    assert (row.sample_rate, row.sample_bits, row.n_channels, row.n_samples) == (11025, 16, 2, 2)
    assert bad.count() == 1 and "b.wav" in bad.first().filename


def test_file_list_prefix(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a.mp3\n/b.mp3\n\n")
    assert {r.path for r in lines.read_file_list(spark, str(tmp_path / "l.txt"), "/m").collect()} == {"/m/a.mp3", "/b.mp3"}
    assert lines.read_file_list(spark, str(tmp_path / "l.txt")).count() == 2


def test_append_is_harmless_when_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "id string, v int")
    for df in (first, first, first.union(spark.createDataFrame([("c", 3)], "id string, v int"))):
        text.append_new_only(df, path)
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_ranking_csv_has_positions(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5, [1.0, 2.0]), ("a", 0.1, [3.0, 4.0])], "id string, aggregated double, scores array<double>")
    text.write_ranking_csv(df, str(tmp_path / "r"))
    rows = spark.read.csv(str(tmp_path / "r"), header=True).orderBy(F.col("position").cast("int")).collect()
    assert [(r.position, r.id, r.scores) for r in rows] == [("0", "a", "[3.0,4.0]"), ("1", "b", "[1.0,2.0]")]


def test_ragged_lines_fail_or_stay_as_they_are(spark, tmp_path):
    path = tmp_path / "ragged.rp"
    path.write_text('a,1,2\n\nb,1,2,3,4\n"c, ""d""",1\ne,,2\n')
    with pytest.raises(Exception, match="has not 3 fields but 5"):
        tables.read_features_csv(spark, str(path)).collect()
    kept = {r.id: r.vec for r in tables.read_features_csv(spark, str(path), ragged="keep").collect()}
    assert kept == {"a": [1.0, 2.0], "b": [1.0, 2.0, 3.0, 4.0], 'c, "d"': [1.0], "e": [None, 2.0]}
    last = tables.read_features_csv(spark, str(path), [-1, 0], ids_only=True, ragged="keep").collect()
    assert sorted((r.id, r.id2) for r in last) == [("1", 'c, "d"'), ("2", "a"), ("2", "e"), ("4", "b")]
    with pytest.raises(ValueError):
        tables.read_features_csv(spark, str(path), ragged="drop")


def test_fields_around_quotes(spark):
    lines_ = [',"a",1', '"a",1', 'a,"b, ""c""",', ',,"x"', '"",', '"a"', ",", "a;b", '" a ",2,"",""', ',"",']
    got = df_of(spark, *lines_).select(tables.split_fields(F.col("value"))).collect()
    want = [["", "a", "1"], ["a", "1"], ["a", 'b, "c"', ""], ["", "", "x"], ["", ""], ["a"], ["", ""], ["a;b"], [" a ", "2", "", ""], ["", "", ""]]
    assert [r[0] for r in got] == want
    semicolon = df_of(spark, ';"a;b";1', "x;y").select(tables.split_fields(F.col("value"), ";")).collect()
    assert [r[0] for r in semicolon] == [["", "a;b", "1"], ["x", "y"]]


def test_empty_first_field_is_kept(spark, tmp_path):
    (tmp_path / "f").write_text(',"a",1\n"x, y","b",2\n')
    for ragged in ("keep", "fail"):
        rows = tables.read_features_csv(spark, str(tmp_path / "f"), [0, 1], ragged=ragged).collect()
        assert [(r.id, r.id2, r.vec) for r in rows] == [(None, "a", [1.0]), ("x, y", "b", [2.0])]


def test_ids_with_line_breaks_are_refused(spark, tmp_path):
    from pyspark.errors import PySparkException

    for bad in ("a\nb", "a\rb"):
        df = spark.createDataFrame([(bad, [1.0])], "id string, v array<double>")
        with pytest.raises(PySparkException, match="line break"):
            text.write_features_csv({"v": df}, str(tmp_path / "out"))


def test_arff_class_names_are_quoted_alike(spark, tmp_path):
    names = ["rock, hard", "drum and bass", "it's", 'say "x"', "%", "pop", ""]
    df = spark.createDataFrame([(c, float(n)) for n, c in enumerate(names)], "class string, f double").select("f", "class")
    text.write_arff(df, str(tmp_path / "a"), "r")
    written = [r.value for r in spark.read.text(str(tmp_path / "a")).collect()]
    header = next(line for line in written if line.startswith("@Attribute class"))
    for name in names:
        quoted = name if name == "pop" else '"' + name.replace('"', '""') + '"'
        assert quoted in header.partition("{")[2] and any(line.endswith(f",{quoted}") for line in written)
    assert sorted((r.vec[0], r["class"]) for r in tables.read_arff(spark, str(tmp_path / "a")).collect())[:6] == [(float(n), c) for n, c in enumerate(names)][:6]


def test_paths_of_stores(tmp_path):
    from echorank.sources.stores import read_bytes, store_uri

    assert store_uri("s3a://bucket/a b.wav") == "s3://bucket/a b.wav" and store_uri("s3n://b/x") == "s3://b/x"
    assert store_uri("dbfs:/mnt/x.wav") == "/dbfs/mnt/x.wav" and store_uri("/plain/x") == "/plain/x" and store_uri("file:/x/y") == "/x/y"
    assert store_uri("gs://b/x") == "gs://b/x" and store_uri("hdfs://n:8020/x") == "hdfs://n:8020/x"
    with pytest.raises(ValueError, match="streaming.media"):
        store_uri("viewfs://c/x")
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert read_bytes(str(tmp_path / "f.bin")) == read_bytes(f"file:{tmp_path}/f.bin") == read_bytes(f"file://{tmp_path}/f.bin") == b"abc"
