"""Order fingerprints against plain reads of the files."""

import random

import pytest

from echorank.operators import fileorder
from echorank.sinks import text
from echorank.sources.tables import read_feature_set
from echorank.streaming.once import settings


def write(path, ids):
    path.write_text("".join(f'"{i}",1,2\n' if "," in i else f"{i},1,2\n" for i in ids))
    return str(path)


def prints(spark, paths):
    return {r["table"]: (r["lines"], r["fingerprint"]) for r in fileorder.order_fingerprints(spark, paths).collect()}


@pytest.mark.parametrize("split", [200, 4096, 1 << 20])
def test_fingerprint_does_not_depend_on_splits(spark, tmp_path, split):
    rng = random.Random(1)
    ids = [f"music/a, {i}.mp3" if i % 5 == 0 else f"s{i}" for i in range(1500)]
    other = list(ids)
    other[700], other[701] = other[701], other[700]
    shuffled = rng.sample(ids, len(ids))
    folder = tmp_path / "parts"
    folder.mkdir()
    for n, a in enumerate(range(0, 1500, 400)):
        write(folder / f"part-{n:05d}", ids[a : a + 400])
    paths = {"a": write(tmp_path / "a", ids), "b": write(tmp_path / "b", other), "c": write(tmp_path / "c", shuffled), "d": str(folder), "e": write(tmp_path / "e", ids[:-1])}
    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}):
        found = prints(spark, paths)
        assert found["a"] == found["d"] and found["a"][0] == 1500 and len({f for _, f in found.values()}) == 4
        numbered = sorted((r.position, r.id) for r in fileorder.numbered_ids(spark, paths["b"]).collect())
        assert numbered == list(enumerate(other))
        wrong = fileorder.order_differences(spark, {"a": paths["a"], "b": paths["b"]}).collect()
        assert sorted((r.position, r.id, r.a, r.b) for r in wrong) == sorted(
            [(700, ids[700], 1, 0), (701, ids[701], 1, 0), (700, ids[701], 0, 1), (701, ids[700], 0, 1)]
        )
        assert fileorder.order_differences(spark, {"a": paths["a"], "d": paths["d"]}).count() == 0
        longer = fileorder.order_differences(spark, {"a": paths["a"], "e": paths["e"]}).collect()
        assert [(r.position, r.id, r.a, r.e) for r in longer] == [(1499, ids[-1], 1, 0)]


def test_value_by_hand(spark, tmp_path):
    hashes = [r[0] % (1 << 64) for r in spark.sql("SELECT xxhash64(v) FROM VALUES ('x'), ('y'), ('x') AS t(v)").collect()]
    want = [sum(h % p * pow(b, i, p) for i, h in enumerate(hashes)) % p for b, p in zip(fileorder.BASES, fileorder.PRIMES)]
    assert prints(spark, {"a": write(tmp_path / "a", ["x", "y", "x"])}) == {"a": (3, f"{want[0]:08x}{want[1]:08x}")}
    assert fileorder._powers(9, 7, 11).tolist() == [pow(7, i, 11) for i in range(9)]


def test_feature_sets_can_demand_the_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", [float(i)]) for i in range(9)], "id string, v array<double>")
    stub = str(tmp_path / "set")
    named = {t: rows.withColumnRenamed("v", t) for t in ("rp", "rh", "ssd")}
    text.write_features_csv({"rp": named["rp"].orderBy("id"), "rh": named["rh"].orderBy("id"), "ssd": named["ssd"].orderBy(named["ssd"].id.desc())}, stub)
    assert set(read_feature_set(spark, stub, ["rp", "rh"], check_order=True)) == {"rp", "rh"}
    read_feature_set(spark, stub, ["rp", "ssd"])
    with pytest.raises(ValueError, match="line 1: s0 .1, 0."):
        read_feature_set(spark, stub, ["rp", "ssd"], check_order=True)


def test_blank_and_empty_files(spark, tmp_path):
    (tmp_path / "a").write_text("\nx,1\n\n  \ny,2\n")
    (tmp_path / "b").write_text("x,1\ny,2")
    (tmp_path / "c").write_text("\n\n")
    found = prints(spark, {n: str(tmp_path / n) for n in "abc"})
    assert found["a"] == found["b"] and "c" not in found
    assert [r.position for r in fileorder.order_differences(spark, {n: str(tmp_path / n) for n in "ac"}).orderBy("position").collect()] == [0, 1]
