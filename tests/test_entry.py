"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# The same job with another feature type; one of them is enough here.
HEAVY = {"signal_rp", "signal_ssd", "signal_mvd", "signal_rh", "signal_trh", "signal_options"}

BASE = {name for module in entry.BASE_MODULES for name in module.QUERIES}
QUERIES = {name: fn for name, fn in entry.queries().items() if name in BASE}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in BASE}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - HEAVY))
def test_query_matches_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = sql.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "aggregated"] and df.count() == 20
