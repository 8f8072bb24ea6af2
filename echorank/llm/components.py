"""Connected components by contraction, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echorank.llm.tables import written


#: A key with more than this share of the rows is dealt to several tasks.
HOT_SHARE = 1000


def hot_keys(left: DataFrame, on: str) -> DataFrame | None:
    """``on, parts``: the values with more than a share of the rows, and how many shares; None without any.

    At most ``HOT_SHARE`` values, and twice as many parts.
    """
    least = max(1, -(-left.count() // HOT_SHARE))
    hot = left.groupBy(on).count().where(F.col("count") > F.lit(least)).select(on, F.ceil(F.col("count") / least).cast("int")).collect()
    return F.broadcast(left.sparkSession.createDataFrame([tuple(r) for r in hot], f"{on} long, parts int")) if hot else None


def salted_join(left: DataFrame, right: DataFrame, on: str, by: str) -> DataFrame:
    """The inner join of ``left`` and ``right``, which has each value of ``on`` once.

    A hot row of ``right`` is copied once per part, and ``left``'s rows of its value are
    dealt to the parts by the column ``by``. So no task gets all rows of a value.
    """
    hot = hot_keys(left, on)
    if hot is None:
        return left.join(right, on)
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")), F.lit(0)).cast("int")
    dealt = left.join(hot, on, "left").withColumn("_part", part).drop("parts")
    copied = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copied, [on, "_part"]).drop("_part")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links (a, b)``: the smallest id it reaches.

    Every id moves to the first of itself and its neighbours, and on to where that one
    moved; links are rewritten between the ids that are left. The first round and every
    other one go by the ids, which ends stars and copies at once; the rounds between
    go by a hash, which shortens chains by a constant factor whatever their ids are.
    So rounds grow with the logarithm of the longest chain. A hub's links are a large
    join key, which AQE splits. Rows with a NULL are void; an empty table gives an
    empty one.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    edges, steps = links, []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        by = (lambda c: F.lit(0).cast("long")) if len(steps) % 2 == 0 else (lambda c: F.xxhash64(c, F.lit(len(steps))))
        place = lambda c, by=by: F.struct(by(c).alias("h"), F.col(c).alias("id"))
        pick = both.groupBy("a").agg(F.min(place("b")).alias("n")).select(
            F.col("a").alias("old"), F.least(place("a"), F.col("n"))["id"].alias("new")
        )
        onward = pick.select(F.col("old").alias("new"), F.col("new").alias("newer"))
        steps.append(written(pick.join(onward, "new").select("old", F.col("newer").alias("new")), "cc-step"))
        a, b = (steps[-1].select(F.col("old").alias(c), F.col("new").alias(f"n{c}")) for c in "ab")
        moved = edges.join(a, "a").join(b, "b").where(F.col("na") != F.col("nb"))
        edges = written(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "cc-links")
        if edges.isEmpty():
            break
    labels = steps[0].select(F.col("old").alias("id"), F.col("new").alias("root"))
    for step in steps[1:]:
        labels = labels.join(step, labels["root"] == step["old"], "left").select("id", F.coalesce("new", "root").alias("root"))
    if len(steps) == 1:  # by the ids, so the root is the smallest
        return labels.withColumnRenamed("root", "component")
    labels = written(labels, "cc-labels")
    smallest = labels.groupBy("root").agg(F.min("id").alias("component"))
    return written(labels.join(smallest, "root").select("id", "component"), "cc-components")
