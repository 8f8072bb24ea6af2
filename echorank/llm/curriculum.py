"""Mixing sources by time-varying weights: every document gets its training positions.

A source has a weight for every moment of training, a piecewise linear schedule over the
times 0 to 1. Its integral is the source's share. Targets in words follow from the shares:
no target exceeds ``max_epochs`` times its source, and what is cut off goes to the others
by weight. The source's demand up to time ``t`` is its target times the integral up to
``t`` over the whole integral. A source's documents stand in one fixed random order, one
pass after the other; a copy that begins at word ``w`` of this stream is trained at the
time where the demand reaches ``w``: the inverse of the cumulative demand, a quadratic in
each piece of the schedule. Copies are range-sorted by that time, which interleaves the
sources as the schedules say.

The stream ends where the target does: the last copy of a source is taken up to that word,
so a source's taken words are its target, rounded. No document is taken more than
``max_epochs`` times, rounded up to whole passes.

Only slim rows move (key, source, size), no text. Words before a document are sums over
range partitions plus the sums of the partitions before, so a source that holds a third of
all rows is spread like others. Sources are one row each and never reach the driver.

Defined results: a NULL source is a source of its own, the last; a NULL size counts as 0.
Documents of size 0 get no position and take nothing, like those behind the end of the
stream; copies of equal time stand by key, copy and size. Rows that repeat a key are documents of their own; where source and size agree too
they are interchangeable. The order does not depend on the layout of the input: reruns
agree. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echorank.llm.tables import written

#: A schedule: (time, weight) from time 0 to time 1.
Schedule = Sequence[tuple[float, float]]


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2.0 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def inverse(schedule: Schedule, share: Column) -> Column:
    """The time at which the integral of the schedule reaches ``share`` of the whole.

    In a piece from ``(t0, w0)`` to ``(t1, w1)`` the integral grows as w0 d + slope d d / 2;
    the root is written so that it holds for a slope of 0 too.
    """
    whole, before = integral(schedule), 0.0
    out = F.lit(float(schedule[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (t1 - t0) * (w0 + w1) / 2.0
        pieces.append((before, area, t0, w0, (w1 - w0) / (t1 - t0)))
        before += area
    for before, area, t0, w0, slope in reversed(pieces):
        if area > 0:
            need = share * F.lit(whole) - F.lit(before)
            need = F.when(need > area, F.lit(area)).when(need < 0.0, F.lit(0.0)).otherwise(need)
            under = F.lit(w0 * w0) + F.lit(2.0 * slope) * need
            root = F.lit(w0) + F.sqrt(F.when(under < 0.0, F.lit(0.0)).otherwise(under))
            d = F.when(root > 0.0, F.lit(2.0) * need / root).otherwise(F.lit(0.0))
            out = F.when(share * F.lit(whole) <= before + area, F.lit(float(t0)) + d).otherwise(out)
    return out


def running_sums(rows: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, out: str, place: str = "_at") -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their group before them.

    Rows are range-partitioned and sorted once and written with their ``place``, a number
    that rises in this order and is no row's but its own. Sums inside a partition stay
    there; a group that spans partitions is shifted by its sums in those before, one row
    per group and partition. Rows that agree in everything still split.
    """
    keys = [F.col(c) for c in group]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_rows = tied.repartitionByRange(*keys, *order, "_tie").sortWithinPartitions(*keys, *order, "_tie").drop("_tie")
    placed = written(sorted_rows.withColumn(place, F.monotonically_increasing_id()), "mix-order").withColumn("_part", F.shiftright(place, 33))
    names = [f"_g{i}" for i in range(len(group))]
    inside = Window.partitionBy(*group, "_part").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy(*[c.alias(n) for c, n in zip(keys, names)], F.col("_part").alias("_p"))
        .agg(F.sum(value).alias("_s"))
        .withColumn("_shift", F.coalesce(F.sum("_s").over(before), F.lit(0)))
        .drop("_s")
    )
    same = F.col("_part") == F.col("_p")
    for c, n in zip(keys, names):
        same = same & c.eqNullSafe(F.col(n))
    summed = placed.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(parts, same).withColumn(out, F.col(out) + F.col("_shift")).drop("_part", "_p", "_shift", *names)


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, max_epochs: int) -> DataFrame:
    """Per source its place, size and target; ``sizes`` has ``source`` and ``size``.

    Targets fill up evenly: min(max_epochs * size, level * weight), with the level at
    which they sum to the budget. A source whose cap lies below the level frees words, so
    the level rises until no further source stops; each pass is one aggregate.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = running_sums(per_source.withColumn("_one", F.lit(1)), [], [F.col("source").asc_nulls_last()], "_one", "place").drop("_at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rank = written(rank.drop("_one").withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * max_epochs
    everything = rank.agg(F.sum("source_size")).first()[0] or 0
    left, level, stopped = budget * float(everything), -1.0, -1
    while True:
        stops = cap <= F.lit(level) * F.col("weight")
        free = F.when(stops, 0.0).otherwise(F.col("weight"))
        row = rank.agg(F.sum(stops.cast("long")), F.sum(F.when(stops, cap).otherwise(0)), F.sum(free)).first()
        n, fixed, open_weight = row[0] or 0, row[1] or 0, row[2] or 0.0
        if n == stopped or not open_weight:
            break
        stopped, level = n, (left - float(fixed)) / open_weight
    target = F.least(cap.cast("double"), F.lit(max(level, 0.0)) * F.col("weight"))
    return rank.select("source", "place", "source_size", target.alias("target"))


#: The columns of ``mix``; the key may have none of these names.
NAMES = {"document", "size", "source_size", "target", "copy", "at", "position", "taken"}


def mix(
    docs: DataFrame, key: str, source: str, size: Column, schedules: Sequence[Schedule], budget: float, max_epochs: int, salt: str
) -> DataFrame:
    """The copies of the mix, and a row for each document that is not taken.

    Schedules go to the sources by code point, again from the first one after the last;
    ``budget`` is in units of all sizes. Columns: ``document``, a number of the row in
    ``docs``; ``key``, ``size``, ``source_size``, ``target``; for a copy its number
    ``copy`` from 0, its training time ``at`` and its ``position``, the words trained
    before it; ``taken``, its words in the mix (0 where nothing is taken).
    """
    if key in NAMES:
        raise ValueError(f"the key column may not be called {key}")
    slim = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    slim = written(slim, "mix-sizes")
    targets = source_targets(slim.select("source", "size"), [integral(s) for s in schedules], budget, max_epochs)
    deal = F.md5(F.concat(F.lit(salt), F.coalesce(F.col("_key").cast("string"), F.lit(""))))
    order = [F.col("_deal"), F.col("_key"), F.col("size")]
    stream = running_sums(slim.withColumn("_deal", deal), ["source"], order, "size", "start", "document").drop("_deal")
    facts = targets.select(F.col("source").alias("_s"), "place", "source_size", "target")
    stream = stream.join(facts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    end, copies = F.round("target").cast("long"), []
    for c in range(max_epochs):
        first = F.col("start") + F.lit(c) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), end - first)).cast("long")
        share = first.cast("double") / F.when(F.col("target") > 0, F.col("target"))
        at = F.lit(None).cast("double")
        for i, schedule in enumerate(schedules):
            at = F.when(F.col("place") % len(schedules) == i, inverse(schedule, share)).otherwise(at)
        copies.append(F.struct(F.lit(c).alias("copy"), at.alias("at"), words.alias("taken")))
    used = F.filter(F.array(*copies), lambda p: p["taken"] > 0)
    flat = stream.select("document", "_key", "size", "source_size", "target", F.explode_outer(used).alias("p"))
    flat = flat.select("document", "_key", "size", "source_size", "target", "p.copy", "p.at", F.coalesce("p.taken", F.lit(0)).alias("taken"))
    trained = running_sums(flat, [], [F.col("at").asc_nulls_last(), F.col("_key"), F.col("copy"), F.col("size")], "taken", "position").drop("_at")
    return trained.withColumn("position", F.when(F.col("taken") > 0, F.col("position"))).withColumnRenamed("_key", key)
