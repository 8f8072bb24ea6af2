"""Archives: round trips, revisits and broken files."""

import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from echorank.llm import warc


def page(text):
    return (text * 2000)[:1500]


ROWS = [
    (1, "http://a", page("abc")), (5, "http://b", page("abc")), (3, None, page("abc")), (7, "http://c", "short"), (8, "http://d", "short"),
    (9, "http://e", None), (10, "http://f", ""), (0, "http://g\r\nX: y", page("é")), (4, "http://h", page("é")), (None, "http://i", page("z")), (None, "http://i", page("abc")),
    (6, "http://j", page("q")), (6, "http://j", page("q")), (2, "http://k", page("q")), (11, "http://l", "x\r\n\r\ny" * 100_000),
]


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_round_trip(spark, tmp_path, size):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("holder", F.lit(1))
    manifest = warc.write_archives(pages, str(tmp_path / "w"), size)
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS)
    binary = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(str(tmp_path / "w"))
    for source in (manifest, binary):
        got = warc.read_archives(source).collect()
        assert all(r["problem"] is None for r in got)
        found = sorted(((r["record_id"], r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=str)
        want = []
        for i, _, html in ROWS:
            data = (html or "").encode()
            same = [j for j, _, h in ROWS if h == html and j is not None]
            refer = max(same) if len(data) >= 1000 and same and len([1 for _, _, h in ROWS if h == html]) > 1 else None
            refer = None if refer == i else refer
            want.append((warc.record_id(i), hashlib.sha1(data).hexdigest(), len(data), "response" if refer is None else "revisit", None if refer is None else warc.record_id(refer)))
        assert found == sorted(want, key=str)
        assert {r["payload"].decode() for r in got if r["payload"] is not None} == {h or "" for _, _, h in ROWS}


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, str(tmp_path / "w"))).count() == 0


def records():
    return [warc.record(f"urn:page:{i}", f"http://x/{i}", "response", page(f"text {i} ").encode(), None, warc.base32_sha1(page(f"text {i} ").encode())) for i in range(40)]


def test_frames_and_dictionary():
    made = warc.archive(records())
    assert made[:4] == b"\x5d\x2a\x4d\x18" and int.from_bytes(made[4:8], "little") > 0
    assert [d for d, _ in warc.frames(made)] == records()
    size = int.from_bytes(made[4:8], "little")
    packed = zstandard.ZstdCompressor().compress(made[8 : 8 + size])  # the dictionary may be a frame itself
    assert [d for d, _ in warc.frames(made[:4] + len(packed).to_bytes(4, "little") + packed + made[8 + size :])] == records()
    assert list(warc.frames(made[:-3]))[-1][1] == "frame too short"
    assert list(warc.frames(b"no archive at all"))[0][1] == "no dictionary frame"
    assert list(warc.frames(made[:20]))[0][1] == "dictionary frame too short"
    assert list(warc.frames(made + b"rubbish that is no frame"))[-1][1].startswith("broken frame")


def test_validation():
    good = records()[0]
    assert warc.parse(good)["problem"] is None
    for old, new, problem in [
        (b"WARC/1.1", b"WARC/9.9", "no WARC header"), (b"WARC-Type: response\r\n", b"", "no warc-type"), (b"WARC-Date:", b"WARC Date:", "header syntax"),
        (b"\r\n\r\nHTTP", b"1\r\n\r\nHTTP", "record length"), (b"text 0 text", b"text 1 text", "block digest"),
    ]:
        assert warc.parse(good.replace(old, new, 1))["problem"] == problem
    assert warc.bare_hex(None) is None and warc.bare_hex("sha1:" + "a" * 39) is None
    assert warc.bare_hex("SHA1:" + "0A" * 20) == "0a" * 20
