"""Opening single files inside tasks, by the paths that Spark lists."""

from __future__ import annotations

import re

from pyarrow import fs

# Schemes of the Hadoop connectors, and the names Arrow has for the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "abfs": "abfs", "gs": "gs", "hdfs": "hdfs", "file": "file", "s3": "s3"}


def store_uri(path: str) -> str:
    """A path as Spark lists it, as Arrow opens it.

    ``dbfs:/x`` is the mounted file ``/dbfs/x``. Stores that Arrow does not know are an
    error that says what reads them: Spark's own binary files, as ``streaming.media`` does.
    """
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if not scheme:
        return path
    name, rest = scheme.group(1).lower(), path[scheme.end() :]
    if name == "dbfs":
        return "/dbfs/" + rest.lstrip("/")
    if name not in SCHEMES:
        raise ValueError(f"tasks cannot open {name}: paths, use streaming.media, where Spark reads the files")
    if name == "file":
        return "/" + rest.lstrip("/")
    return f"{SCHEMES[name]}:{rest}"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the place in it."""
    return fs.FileSystem.from_uri(store_uri(path))


def read_bytes(path: str) -> bytes:
    store, place = open_store(path)
    with store.open_input_stream(place, compression=None) as f:
        return f.read()
