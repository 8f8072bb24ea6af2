"""Matrix BPE against the public library, and round trips."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from echorank.llm.bpe import Encoder, Vocabulary, decode, encode, vocabulary_lines
from echorank.llm.bpe_queries import VOCABULARY, op6_matrix_bpe

PATH = P.path(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary_lines(PATH))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    out = ["", None, " ", "a", "a" * 3000, "ab" * 400, "日本語 テキスト" * 30, "<|endoftext|>", "\n\n\t x  ", "é" * 700, " " * 500 + "b", "1" * 300, "don't we'll 'S"]
    out += ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(400)) for _ in range(5)]
    return out + ["".join(rng.choice("abcdehilnorst ") for _ in range(rng.randrange(300))) for _ in range(200)]


def test_same_ids_as_the_library(library):
    encoder = Encoder(Vocabulary(vocabulary_lines(PATH)), P.PATTERN)
    for _ in range(2):  # also with kept pieces
        flat, sizes = encoder(texts())
        at = 0
        for text, n in zip(texts(), sizes.tolist()):
            ids = flat[at : at + n]
            assert ids.tolist() == library.encode_ordinary(text or "")
            assert encoder.vocabulary.decode(ids).tobytes().decode() == (text or "")
            at += n


def test_unknown_ids_are_an_error():
    with pytest.raises(ValueError):
        Vocabulary(vocabulary_lines(PATH)).decode(__import__("numpy").array([10**6]))


def test_columns_and_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(texts()[:30])] + [(None, "x"), (3, "a"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text", F.lit("mine"))
    tokens = encode(docs, PATH, P.PATTERN, ["doc_id", "__text"])
    assert sorted(((r["doc_id"], r["ids"]) for r in tokens.collect()), key=str) == sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=str)
    back = decode(tokens, PATH, ["doc_id"])
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert encode(docs.limit(0), PATH, P.PATTERN, ["doc_id"]).count() == 0


def test_query(spark, library):
    import hashlib
    import struct

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op6_matrix_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode_ordinary(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()
