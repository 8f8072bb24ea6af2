"""Registered queries against their SQL on the smallest tables, and the pipeline stage by stage."""

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from echorank.llm import queries, toxicity
from echorank.llm.toxicity_queries import classifier
from tests.llm import test_contamination as contamination
from tests.llm import test_neardup as neardup
from tests.llm import test_pii as pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_names():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = sql.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want and want


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first and after every stage, with some odd rows added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [
        (90_001, None, None, None, None), (90_002, "", "en", "s", 0), (None, "only words", "en", "s", 10), (None, None, None, None, None),
        (90_003, "twice the same row here", "en", "s", 23), (90_003, "twice the same row here", "en", "s", 23), (90_004, "mail a@b.co or +1 (456) 555-2186", "en", "s", 33),
    ]
    out = [docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("mine")).withColumn("component", F.lit(1))]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], SF), "test-stage"))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stage_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert stages[-1].columns == [c for c in stages[0].columns if c != "text"] + ["ids", "n_tokens"]


def test_toxicity_stage(spark, stages):
    scored = toxicity.with_score(stages[0].select("doc_id", "text"), classifier(spark, SF), "s")
    bad = {r["text"] for r in scored.where("s >= 0.3").collect()}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r[1] not in bad] and bad


def test_near_duplicate_stage(stages):
    before = rows(stages[1])
    found = neardup.brute([(r[0], r[1]) for r in before], 5, 80)
    kept = {doc for doc, _, component in found if doc == component}
    assert rows(stages[2]) == sorted({r for r in before if r[0] is not None and r[0] in kept}, key=str) + [r for r in before if r[0] is None]


def test_decontamination_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in contamination.brute([(r[0], r[1]) for r in rows(stages[2])], items) if r[4]}
    assert rows(stages[3]) == [r for r in rows(stages[2]) if r[0] not in bad]


def test_personal_data_stage(stages):
    after = {r[0]: r for r in rows(stages[4])}
    assert len(rows(stages[4])) == len(rows(stages[3]))
    for r in rows(stages[3]):
        if r[0] is not None:
            masked = after[r[0]]
            assert masked[2:4] == r[2:4] and masked[5:] == r[5:]
            if r[1] is not None:
                assert masked[4] == len(masked[1]) and not any(k == "email" for k, _, _ in pii.plain(masked[1]))
                if not any(c.isdigit() or c == "@" for c in r[1]):
                    assert masked[1] == r[1]
    assert after[90_004][1] == "mail <EMAIL> or <PHONE>"


def test_token_stage(stages):
    from tests.llm.test_bpe import PATH, base64, vocabulary_lines

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary_lines(PATH))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((r[0], library.encode_ordinary(r[1] or "")) for r in rows(stages[4])), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in stages[5].collect()), key=str) == want
    assert stages[5].where(F.col("n_tokens") != F.size("ids")).isEmpty()


def test_unlike_rows_of_one_id_stay(spark):
    """Ids 6 and 7 copy one of the two unlike texts of id 5; the other one stays."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    texts = [(5, one), (5, two), (6, one), (7, two), (7, two), (8, ""), (8, ""), (8, None), (9, one + " more"), (None, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, n) for n, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, row long")
    found = []
    for order in ("row", F.desc("row")):
        kept = corpus_pipeline.drop_near_duplicates(spark, docs.orderBy(order), SF)
        assert kept.columns == docs.columns
        found.append(sorted(r["row"] for r in kept.collect()))
    assert found[0] == found[1] and found[0] in ([0, 1, 5, 7, 9], [0, 1, 6, 7, 9])


def test_tokens_that_do_not_decode_fail(spark, monkeypatch):
    from pyspark.errors import PySparkException

    monkeypatch.setattr(corpus_pipeline.bpe.Vocabulary, "decode", lambda self, ids: np.frombuffer(b"else", np.uint8))
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    with pytest.raises(PySparkException):
        corpus_pipeline.encode(spark, docs, SF).collect()


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "ids", "n_tokens"} <= set(got.columns) and got.count() > 100


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
