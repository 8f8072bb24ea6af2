"""The source mix against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from echorank.llm.curriculum import integral, inverse, mix, running_sums
from echorank.llm.curriculum_queries import SCHEDULES

COLUMNS = "doc_id long, source string, n long, size string, position string, _part int, start long"


def levels(sizes, weights, budget, epochs):
    """Targets by cutting off and sharing out again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, budget * sum(sizes.values()), set(order)
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if epochs * sizes[s] <= unit * w[s]}
        if not over:
            target.update({s: unit * w[s] for s in free})
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        free -= over
    return order, target


def plain(rows, schedules, budget, epochs):
    sizes = {}
    for _, source, n in rows:
        sizes[source] = sizes.get(source, 0) + (n or 0)
    order, target = levels(sizes, [integral(s) for s in schedules], budget, epochs)
    out = []
    for s in order:
        mine = sorted(((i, n or 0) for i, source, n in rows if source == s), key=lambda r: (hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or -1, r[1]))
        end, start = round(target[s]), 0
        for i, n in mine:
            taken = [max(0, min(n, end - start - c * sizes[s])) for c in range(epochs)]
            out.append((i, n, sizes[s], round(target[s], 6), sum(taken)))
            start += n
    return sorted(out, key=str)


def digest(copies):
    rows = copies.groupBy("document").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").alias("taken"))
    return sorted(((r[1], r[2], r[3], round(r[4], 6), r[5]) for r in rows.collect()), key=str)


def run(spark, rows, budget=1.5, epochs=2, schedules=SCHEDULES):
    df = spark.createDataFrame([(i, s, n, "x", "y", 1, 7) for i, s, n in rows], COLUMNS)
    return mix(df, "doc_id", "source", F.col("n"), schedules, budget, epochs, "mix:")


def case():
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", "d", "é", "z", None]), rng.randint(1, 40)) for i in range(300)]
    rows += [(1000 + i, "hot", rng.randint(0, 9)) for i in range(200)] + [(1, "a", 5), (1, "a", 5), (None, "b", 3), (None, None, 4)]
    return rows + [(2000, "tiny", 1), (2001, "zero", 0), (2002, "zero", None), (2003, "giant", 5000)]


def test_equals_plain_mix(spark):
    rows = case()
    got = digest(run(spark, rows))
    assert got == plain(rows, SCHEDULES, 1.5, 2)
    assert all(taken <= 2 * size for _, size, _, _, taken in got)
    assert digest(run(spark, rows[::-1])) == got


def test_sources_come_near_their_targets_at_every_time(spark):
    rows = [(i, f"s{i % 3}", 1 + i % 5) for i in range(3000)]
    copies = run(spark, rows).where("taken > 0").orderBy("position").collect()
    source = {i: s for i, s, _ in rows}
    target = {source[r["doc_id"]]: r["target"] for r in copies}
    assert sum(r["taken"] for r in copies) == pytest.approx(1.5 * sum(n for _, _, n in rows), abs=3)
    assert [r["position"] for r in copies] == [sum(r["taken"] for r in copies[:i]) for i in range(len(copies))]
    assert all(a["at"] <= b["at"] for a, b in zip(copies, copies[1:]))
    for t in (0.1, 0.37, 0.5, 0.8):
        for i, s in enumerate(sorted(target)):
            seen = sum(r["taken"] for r in copies if source[r["doc_id"]] == s and r["at"] < t)
            steps = [(j + 0.5) * t / 500 for j in range(500)]
            part = sum(weight(SCHEDULES[i], x) for x in steps) * t / 500 / integral(SCHEDULES[i])
            assert seen == pytest.approx(part * target[s], abs=6)


def weight(schedule, t):
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        if t <= t1:
            return w0 + (w1 - w0) * (t - t0) / (t1 - t0)


def test_epochs_and_small_budgets(spark):
    rows = case()
    for budget, epochs in ((0.3, 1), (1.0, 1), (2.7, 3)):
        assert digest(run(spark, rows, budget, epochs)) == plain(rows, SCHEDULES, budget, epochs)


def test_nothing(spark):
    assert run(spark, []).count() == 0
    got = run(spark, [(1, "a", 0), (2, None, None)]).collect()
    assert sorted((r["doc_id"], r["taken"], r["position"], r["target"]) for r in got) == [(1, 0, None, 0.0), (2, 0, None, 0.0)]


def test_inverse_of_every_piece(spark):
    schedules = [*SCHEDULES, [(0, 0), (0.5, 0), (1, 4)], [(0, 2), (0.3, 0), (0.6, 0), (1, 1)], [(0, 1), (1, 1)]]
    for schedule in schedules:
        rows = spark.range(101).select((F.col("id") / 100).alias("s"), inverse(schedule, F.col("id") / 100).alias("t")).collect()
        for r in rows:
            part = sum(weight(schedule, (j + 0.5) * r["t"] / 2000) for j in range(2000)) * r["t"] / 2000
            assert part == pytest.approx(r["s"] * integral(schedule), abs=2e-3)


def test_running_sums_of_rows_that_agree(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4500, "hot").alias("g"), F.lit(1).alias("v"))
    got = running_sums(rows, ["g"], [F.col("v")], "v", "before").groupBy("g").agg(F.sort_array(F.collect_list("before"))).collect()
    assert {r[0]: r[1] for r in got} == {"hot": list(range(4500)), None: list(range(500))}


def test_key_name_is_refused(spark):
    with pytest.raises(ValueError):
        mix(spark.createDataFrame([(1, "a")], "size long, source string"), "size", "source", F.lit(1), SCHEDULES, 1.5, 2, "")
