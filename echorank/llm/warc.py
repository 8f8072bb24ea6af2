"""WARC archives compressed with Zstandard and a dictionary: writer, reader, validation.

An archive is a skippable frame with the dictionary (as the published WARC/Zstandard
convention has it: magic 0x184D2A5D, the dictionary itself plain or a frame), then one
frame per record. Archives are written by the tasks into a shared folder, each under
a name of its own and moved into place when complete. The manifest, a table that only
tasks that succeeded add to, names the archives that count: what a lost task has left
is never read. The reader loads the dictionary from the first frame, decodes frame by
frame, and validates header syntax, lengths and digests of every record; what is
wrong is said in a column, not dropped.

Defined results: a NULL payload is empty; a NULL URL has no target header; a NULL id
has a record id without a number and is never referred to; repeated rows each give a
record; an empty table gives no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from echorank.llm.tables import written

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: Payload bytes of an archive before a new one begins; of samples for a dictionary; its size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 32 << 20, 1 << 20, 32 << 10
#: Record bytes in a batch that is read, and tasks that read a manifest at most.
READ_BYTES, MOST_TASKS = 4 << 20, 10_000
#: Equal payloads from here on are stored once.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")
RECORD = "record_id string, record_type string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary, problem string"


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def bare_hex(digest: str | None) -> str | None:
    """A labelled SHA-1, base 32 or 16, as bare lower-case hex; None if it is neither."""
    label, _, value = (digest or "").partition(":")
    if label.lower() != "sha1":
        return None
    try:
        raw = base64.b32decode(value.upper()) if len(value) == 32 else bytes.fromhex(value)
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def record(record_id: str, url: str | None, kind: str, payload: bytes, refers_to: str | None, digest: str) -> bytes:
    """A response with its payload, or a revisit that has the HTTP header only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)))
    fields.append(("WARC-Payload-Digest", digest))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Truncated", "length")]
    else:
        block += payload
    fields += [("WARC-Block-Digest", base32_sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> bytes:
    """A dictionary trained on an archive's first records; empty if they are too few."""
    samples, size = [], 0
    for r in records:
        samples.append(r[: SAMPLE_BYTES // 8])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:  # samples too much alike or too small
        return b""


def archive(records: list[bytes]) -> bytes:
    """The dictionary frame and a frame for every record."""
    trained = dictionary_of(records)
    data = zstandard.ZstdCompressionDict(trained) if trained else None
    packer = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=True, write_checksum=True)
    head = struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained
    return head + b"".join(packer.compress(r) for r in records)


def frames(content: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """The records of an archive, one per frame; on a broken frame a problem, and the end."""
    if len(content) < 8 or struct.unpack_from("<I", content)[0] != DICTIONARY_MAGIC:
        yield None, "no dictionary frame"
        return
    size = struct.unpack_from("<I", content, 4)[0]
    at, trained = 8 + size, content[8 : 8 + size]
    if at > len(content):
        yield None, "dictionary frame too short"
        return
    if trained[:4] == FRAME_MAGIC:
        trained = zstandard.ZstdDecompressor().decompress(trained, max_output_size=1 << 27)
    data = zstandard.ZstdCompressionDict(trained) if trained else None
    reader = zstandard.ZstdDecompressor(dict_data=data)
    view = memoryview(content)
    while at < len(content):
        one = reader.decompressobj()
        parts, used = [], at
        try:
            while used < len(content) and not one.eof:
                piece = view[used : used + (1 << 16)]
                parts.append(one.decompress(piece))
                used += len(piece)
        except zstandard.ZstdError as e:
            yield None, f"broken frame: {e}"
            return
        if not one.eof:
            yield None, "frame too short"
            return
        at = used - len(one.unused_data)
        yield b"".join(parts), None


def parse(data: bytes) -> dict:
    """Fields of one record; ``problem`` is NULL if header, lengths and digests hold."""
    out = dict.fromkeys(("record_id", "record_type", "target", "refers_to", "payload_digest", "payload_bytes", "payload", "problem"))
    end = data.find(b"\r\n\r\n")
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")) or end < 0:
        return out | {"problem": "no WARC header"}
    head, fields, at = data[: end + 2], {}, 10
    while at < len(head):
        m = HEADER.match(head, at)
        if not m:
            return out | {"problem": "header syntax"}
        fields[m[1].lower().decode()] = m[2].decode("utf-8", "replace").strip()
        at = m.end()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields)
    if missing:
        return out | {"problem": "no " + min(missing)}
    out |= {"record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "target": fields.get("warc-target-uri")}
    out |= {"refers_to": fields.get("warc-refers-to", "").strip("<>") or None}
    length = int(fields["content-length"]) if fields["content-length"].isdigit() else -1
    block = data[end + 4 : end + 4 + max(0, length)]
    if length < 0 or len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        return out | {"problem": "record length"}
    if "warc-block-digest" in fields and bare_hex(fields["warc-block-digest"]) != hashlib.sha1(block).hexdigest():
        return out | {"problem": "block digest"}
    http, _, payload = block.partition(b"\r\n\r\n")
    m = re.search(rb"\r\ncontent-length:[ \t]*([0-9]+)", http, re.I)
    out["payload_bytes"] = int(m[1]) if m else len(payload)
    out["payload_digest"] = bare_hex(fields.get("warc-payload-digest"))
    if out["record_type"] == "revisit":
        return out | {"problem": None if out["refers_to"] and out["payload_digest"] else "revisit without reference"}
    if len(payload) != out["payload_bytes"]:
        return out | {"problem": "payload length"}
    actual = hashlib.sha1(payload).hexdigest()
    if out["payload_digest"] not in (None, actual):
        return out | {"problem": "payload digest"}
    return out | {"payload": payload, "payload_digest": actual}


def record_id(page_id: int | None) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


def with_references(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to``: the page that holds an equal payload, or NULL.

    Groups of equal payloads are found by a partial aggregate over digests; the join
    of the pages with them is a plain one, whose hot digest AQE splits.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    digest = F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha1("html"))
    alone = F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))  # spreads pages without a digest
    holders = (
        rows.select("page_id", digest.alias("digest"))
        .where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("holder").isNotNull())
        .select("digest", "holder")
    )
    joined = rows.withColumn("digest", F.coalesce(digest, alone)).join(holders, "digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages (page_id, url, html)``; the manifest: ``path, records, bytes``."""

    def task(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def put(records):
            content, name = archive(records), uuid.uuid4().hex
            with store.open_output_stream(f"{root}/_{name}.part", compression=None) as out:
                out.write(content)
            store.move(f"{root}/_{name}.part", f"{root}/{name}.warc.zst")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.warc.zst"], "records": [len(records)], "bytes": [len(content)]})

        records, size = [], 0
        for batch in batches:
            for page, url, html, refers_to in zip(*(c for c in batch.columns)):
                payload = html.as_py().encode()
                page, refers_to = page.as_py(), refers_to.as_py()
                kind = "response" if refers_to is None else "revisit"
                records.append(record(record_id(page), url.as_py(), kind, payload, record_id(refers_to), base32_sha1(payload)))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield put(records)
                    records, size = [], 0
        if records:
            yield put(records)

    return written(with_references(pages).mapInArrow(task, "path string, records long, bytes long"), "warc-manifest")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: ``RECORD`` and the archive's ``path``.

    ``archives`` has ``path`` (a manifest, one archive opened at a time by the tasks),
    or ``path`` and ``content`` as Spark's ``binaryFile`` source gives them.
    """
    kind = T.StructType.fromDDL(RECORD + ", path string")
    schema, names = to_arrow_schema(kind), kind.names

    def rows_of(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for data, problem in frames(content):
            rows.append((dict.fromkeys(names) | {"problem": problem} if data is None else parse(data)) | {"path": path})
            size += len(data or b"")
            if size > READ_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def opened(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as f:
                    yield from rows_of(path, f.read())

    def given(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from rows_of(path, content.as_buffer().to_pybytes())

    if "content" in archives.columns:
        return archives.select("path", "content").mapInArrow(given, kind)
    tasks = max(1, min(archives.count(), MOST_TASKS))  # rows are tiny, their work is not
    return archives.select("path").repartition(tasks).mapInArrow(opened, kind)
