"""Streams that append every item once: state, restarts, media files."""

import io
import wave

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from echorank.sources.lines import PARSERS
from echorank.streaming.media import extract_stream, streamed_features
from echorank.streaming.once import STATE_STORE, append_once_stream


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(f"{line}\n" for line in lines))


def stored(spark, table):
    return sorted((r.id, r.rh[0]) for r in spark.read.parquet(str(table)).collect())


def start(spark, tmp_path, **more):
    query = append_once_stream(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check"), **{"ext": "rh", **more})
    query.awaitTermination()
    return query


def test_ids_are_state_and_not_read_back(spark, tmp_path):
    put(tmp_path / "in", "a.rh", "x,1,2", "y,3,4", "x,1,2")
    assert start(spark, tmp_path).lastProgress["numInputRows"] == 3
    put(tmp_path / "in", "b.rh", "y,9,9", "z,5,6", "bad")
    query = start(spark, tmp_path)
    got = {r.id: r.rh for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    assert got["x"] == [1.0, 2.0] and got["y"] == [3.0, 4.0] and got["z"] == [5.0, 6.0] and len(got) == 4
    progress = query.recentProgress[0]
    assert progress["stateOperators"][0]["numRowsTotal"] == 4
    assert [s["numInputRows"] for s in progress["sources"]] == [3]  # the new file alone; the table is no source
    plan = query._jsq.explainInternal(False)
    assert str(tmp_path / "table") not in str(plan)
    start(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4


def test_rows_without_id_are_left_out(spark, tmp_path):
    put(tmp_path / "in", "a.rh", "x,1", "y,2")
    without = lambda lines: PARSERS["rh"](lines).withColumn("id", F.when(F.col("id") != "y", F.col("id")))
    start(spark, tmp_path, ext=None, parse=without)
    assert stored(spark, tmp_path / "table") == [("x", 1.0)]


def test_a_failed_batch_is_done_again(spark, tmp_path):
    put(tmp_path / "in", "a.rh", "x,1", "y,2")
    start(spark, tmp_path)
    put(tmp_path / "in", "b.rh", "y,7", "z,3", "w,4")
    stop = F.when(F.col("id") == "w", F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("id"))
    with pytest.raises(StreamingQueryException):
        start(spark, tmp_path, ext=None, parse=lambda lines: PARSERS["rh"](lines).withColumn("id", stop))
    assert stored(spark, tmp_path / "table") == [("x", 1.0), ("y", 2.0)]
    start(spark, tmp_path)
    assert stored(spark, tmp_path / "table") == [("w", 4.0), ("x", 1.0), ("y", 2.0), ("z", 3.0)]


def test_several_batches_and_partitions_of_state(spark, tmp_path):
    for n in range(6):
        put(tmp_path / "in", f"{n}.rh", *[f"s{i},{i}" for i in range(n * 5, n * 5 + 10)])
    before = {k: spark.conf.get(k, None) for k in (*STATE_STORE, "spark.sql.shuffle.partitions")}
    query = start(spark, tmp_path, max_files_per_trigger=1, state_partitions=3)
    assert {k: spark.conf.get(k, None) for k in before} == before
    assert stored(spark, tmp_path / "table") == sorted((f"s{i}", float(i)) for i in range(35))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 6
    assert len(list((tmp_path / "check" / "state" / "0").iterdir())) >= 3


def tone(path, seconds=7.0, rate=11025):
    path.parent.mkdir(parents=True, exist_ok=True)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.sin(np.arange(int(seconds * rate)) / 9) * 9000).astype("<i2").tobytes())
    path.write_bytes(out.getvalue())


def test_media_files_are_read_once(spark, tmp_path):
    def run():
        query = extract_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), ["rp", "rh"], max_files_per_trigger=2)
        query.awaitTermination()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    for name in ("pop/a.wav", "rock/b.WAV", "rock/notes.doc"):
        tone(tmp_path / "in" / name)
    (tmp_path / "in" / "rock" / "broken.wav").write_bytes(b"RIFF and no more")
    assert sum(run()) == 3
    tone(tmp_path / "in" / "pop" / "c.wav")
    assert run() == [1]
    assert run() == []
    found = streamed_features(spark, str(tmp_path / "out"), ["rp", "rh"], label=True)
    names = sorted((r.id, r.id2) for r in found["rh"].collect())
    assert [n[1] for n in names] == ["pop", "pop", "rock"] and len({n[0] for n in names}) == 3
    assert found["rp"].count() == 3 and len(found["rp"].first().rp) == 1440
    assert [r.id.endswith("broken.wav") for r in found["errors"].collect()] == [True]
    assert {r.sample_rate for r in found["audit"].collect()} == {11025} and found["audit"].count() == 3
