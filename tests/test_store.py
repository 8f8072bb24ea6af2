"""The bucketed feature store: equal to a plain join, and without a shuffle."""


import pytest
from pyspark.sql import functions as F

from echorank.operators.joins import assemble_features
from echorank.sinks import store


def tables(spark, n=300):
    ids = spark.range(n).select(F.concat(F.lit("s"), "id").alias("id"), "id")
    ids = ids.toDF("id", "n")
    return {
        "a": ids.select("id", F.array(F.col("n") * 1.0).alias("a")),
        "b": ids.where("n % 7 <> 0").select("id", F.concat(F.lit("x"), "n").alias("b")),
        "c": ids.where("n % 5 <> 0").unionByName(ids.where("n = 11")).select("id", (F.col("n") / 2).alias("c")),
    }


def rows(df):
    return sorted(map(str, df.select("id", "a", "b", "c").collect()))


def test_store_equals_join_and_has_no_exchange(spark, tmp_path):
    own = tables(spark)
    store.write_store(own, str(tmp_path), "plain", 6)
    wide = store.assemble_store(store.open_store(spark, str(tmp_path), "plain", list(own), 6))
    assert rows(wide) == rows(assemble_features(list(own.values()), dedupe=False))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 2 and plan.count("SelectedBucketsCount") <= 3
    store.close_store(spark, "plain", list(own))
    assert not spark.catalog.tableExists("plain_a")


def test_append_and_reopen(spark, tmp_path):
    own = tables(spark)
    store.write_store({n: t.where("id < 's2'") for n, t in own.items()}, str(tmp_path), "parts", 4)
    store.write_store({n: t.where("id >= 's2'") for n, t in own.items()}, str(tmp_path), "parts", 4, append=True)
    store.close_store(spark, "parts", list(own))
    opened = store.open_store(spark, str(tmp_path), "parts", list(own), 4)
    wide = store.assemble_store(opened)
    assert rows(wide) == rows(assemble_features(list(own.values()), dedupe=False))
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        store.open_store(spark, str(tmp_path), "other", ["a"], 5)
    with pytest.raises(ValueError):
        store.open_store(spark, str(tmp_path), "x; DROP", ["a"], 4)


def test_null_and_empty(spark, tmp_path):
    one = spark.createDataFrame([(None, 1), ("a", 2)], "id string, v int")
    two = spark.createDataFrame([], "id string, w int")
    store.write_store({"one": one, "two": two, "three": one.withColumnRenamed("v", "u")}, str(tmp_path), "odd", 2)
    opened = store.open_store(spark, str(tmp_path), "odd", ["one", "two", "three"], 2)
    assert store.assemble_store(opened).count() == 0
    assert [r.id for r in store.assemble_store({"one": opened["one"], "three": opened["three"]}).collect()] == ["a"]
    assert store.bucket_count(opened) == spark.sparkContext.defaultParallelism
    assert store.bucket_count(opened, least=50) == 50
    with pytest.raises(ValueError):
        store.bucket_count({"one": one})
