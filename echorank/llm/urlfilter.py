"""Temporal list join: every capture is judged by the list as it stood when it was fetched.

A list is a log of dated entries (pattern, action, effective). The entries of one
pattern become validity intervals by ``lead``; each capture offers the patterns that
could name its URL (host, parent domains, host with the leading path segments, as many
as the list's longest pattern has), and an as-of join finds the interval that holds the fetch time. Of several active
patterns the most specific one decides: more path segments first, then more host
labels. Actions are ``block``, ``allow`` and ``remove`` (the pattern is off the list).

Defined results: entries of one pattern at one time count as one, ``block`` before
``allow`` before ``remove``; entries with a NULL are void; a URL that is NULL or has
no host, and a NULL fetch time, match nothing and are kept; repeated captures each
give a row. Empty tables give no rows, or captures without a match. The captures'
own columns never clash with those of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """Lower-case host without port or user; '' if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r":[0-9]*$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def patterns_of(url: Column, segments: Column) -> Column:
    """``array<struct<rank, pattern>>``: all patterns of at most so many path segments that could name a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            i.cast("int").alias("rank"), F.array_join(F.slice(labels, n - i + 1, i), ".").alias("pattern")
        ),
    )
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    most = F.least(F.size(parts), segments)
    paths = F.transform(
        F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            (i * 1000 + n).cast("int").alias("rank"),
            F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("pattern"),
        ),
    )
    return F.when(host != "", F.concat(suffixes, paths))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``pattern, action, valid_from, valid_to`` (end exclusive)."""
    order = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    one = (
        entries.where(F.col("pattern").isNotNull() & F.col("action").isNotNull() & F.col("effective").isNotNull())
        .groupBy("pattern", "effective")
        .agg(F.min(F.struct(order.alias("o"), F.col("action").alias("action"))).alias("first"))
    )
    following = F.lead("effective").over(Window.partitionBy("pattern").orderBy("effective"))
    return one.select(
        "pattern",
        F.col("first.action").alias("action"),
        F.col("effective").alias("valid_from"),
        F.coalesce(following, F.to_timestamp(F.lit(FOREVER))).alias("valid_to"),
    ).where(F.col("action") != "remove")


def judge_captures(captures: DataFrame, entries: DataFrame, key: str, url: str, fetched: str) -> DataFrame:
    """One row per capture: ``key``, ``url``, ``fetched``, ``blocked``, ``pattern``, ``action``, ``since``.

    Equal captures are counted first and given back as often at the end, so the
    joins carry each (key, url, time) once. Popular hosts make large join keys; the
    join is a plain equi-join with a time condition, whose large partitions AQE
    splits, and the per-capture maximum is taken within the capture's own key.
    """
    slim = captures.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(fetched).alias("t"))
    distinct = slim.groupBy("k", "u", "t").agg(F.count("*").alias("copies"))
    valid = intervals(entries)
    slashes = F.length("pattern") - F.length(F.replace("pattern", F.lit("/")))
    longest = valid.agg(F.coalesce(F.max(slashes), F.lit(0)).alias("segments"))
    offers = F.explode_outer(patterns_of(F.col("u"), F.col("segments")))
    offered = distinct.crossJoin(F.broadcast(longest)).select("k", "u", "t", "copies", offers.alias("p")).select(
        "k", "u", "t", "copies", F.col("p.rank").alias("rank"), F.col("p.pattern").alias("offer")
    )
    active = offered.join(
        valid,
        (F.col("offer") == F.col("pattern")) & (F.col("t") >= F.col("valid_from")) & (F.col("t") < F.col("valid_to")),
        "left",
    )
    hit = F.when(F.col("pattern").isNotNull(), F.struct("rank", "pattern", "action", "valid_from"))
    best = active.groupBy("k", "u", "t", "copies").agg(F.max(hit).alias("hit"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.col("k").alias(key),
        F.col("u").alias(url),
        F.col("t").alias(fetched),
        F.coalesce(F.col("hit.action") == "block", F.lit(False)).alias("blocked"),
        F.col("hit.pattern").alias("pattern"),
        F.col("hit.action").alias("action"),
        F.col("hit.valid_from").alias("since"),
    )
