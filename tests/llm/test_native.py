"""Shards and URL lists against plain definitions."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from echorank.llm.sharding import assign_shards, directory
from echorank.llm.urlfilter import judge_captures


def brute_shards(rows, limit):
    def key(doc, text):
        inner = hashlib.md5((text or "").encode()).hexdigest()
        return int(hashlib.md5(f"{'' if doc is None else doc}\x1f{inner}".encode()).hexdigest()[:15], 16)

    keyed = [(doc, len((text or "").encode()), key(doc, text)) for doc, text in rows]
    out = []

    def split(some, depth, name):
        if sum(b for _, b, _ in some) <= limit or len(some) <= 1:
            out.extend((doc, b, name, depth, 0) for doc, b, _ in some)
        elif depth == 60:
            per = max(1, limit // max(1, some[0][1]))
            out.extend((doc, b, name, depth, i // per) for i, (doc, b, _) in enumerate(some))
        else:
            for bit in (0, 1):
                part = [r for r in some if (r[2] >> (59 - depth)) & 1 == bit]
                if part:
                    split(part, depth + 1, f"{name}{bit}")

    if keyed:
        split(keyed, 0, "")
    return sorted(out, key=str)


def shards(spark, rows, limit):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("bytes", F.lit(1))
    got = assign_shards(docs, "doc_id", "text", limit)
    sizes = directory(got)
    assert sizes.where((F.col("bytes") > limit) & (F.col("n_rows") > 1)).isEmpty()
    return sorted(((r["doc_id"], r["bytes"], r["shard"], r["depth"], r["page"]) for r in got.collect()), key=str)


def test_shards_split_only_where_needed(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(0, 60)) for i in range(150)]
    rows += [(7, "same text")] * 40 + [(None, None), (None, ""), (500, "y" * 5000)]
    assert shards(spark, rows, 200) == brute_shards(rows, 200)


def test_one_shard_and_none(spark):
    assert shards(spark, [(1, "a"), (2, None)], 100) == brute_shards([(1, "a"), (2, None)], 100)
    assert shards(spark, [], 100) == []


def brute_url(url, t, entries):
    if not url or t is None or "://" not in url:
        return False, None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].rsplit("@", 1)[-1].split(":")[0].lower()
    path = rest[cut:].split("?")[0].split("#")[0]
    if not host:
        return False, None, None
    labels, parts = host.split("."), [p for p in path.split("/") if p]
    offers = [".".join(labels[-i:]) for i in range(1, len(labels) + 1)] + [host + "/" + "/".join(parts[:i]) for i in range(1, min(2, len(parts)) + 1)]
    rank = {"block": 0, "allow": 1, "remove": 2}
    for offer in reversed(offers):
        past = [(e, a) for p, a, e in entries if p == offer and a is not None and e is not None and e <= t]
        if past:
            last = max(e for e, _ in past)
            action = min((a for e, a in past if e == last), key=rank.get)
            if action != "remove":
                return action == "block", offer, action
    return False, None, None


def test_captures_meet_the_list_of_their_day(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    entries = [
        ("example.com", "block", day(10)), ("example.com", "remove", day(20)), ("a.example.com", "allow", day(12)),
        ("a.example.com", "block", day(12)), ("a.example.com/x", "allow", day(5)), ("a.example.com/x/y", "block", day(15)),
        ("org", "block", day(0)), (None, "block", day(0)), ("b.net", None, day(0)), ("b.net", "block", None), ("b.net", "block", day(3)), ("b.net", "block", day(3)),
    ]
    urls = ["http://a.example.com/", "https://u@A.EXAMPLE.com:80/x/y/z?q#f", "http://a.example.com/x", "http://c.example.com?x=/x", "http://b.net", "ftp://w.org/1", "nothing", "", None, "http:///x"]
    captures = [(i, u, day(n)) for i, (u, n) in enumerate((u, n) for u in urls for n in (0, 4, 5, 10, 12, 15, 20, 30))]
    captures += [(1, urls[0], day(12))] * 3 + [(None, urls[4], day(9)), (2, urls[4], None)]
    caps = spark.createDataFrame(captures, "page_id long, u string, t timestamp").withColumn("pattern", F.lit("mine")).withColumn("rank", F.lit(1))
    got = judge_captures(caps, spark.createDataFrame(entries, "pattern string, action string, effective timestamp"), "page_id", "u", "t")
    found = sorted(((r["page_id"], r["u"], r["t"], r["blocked"], r["pattern"], r["action"]) for r in got.collect()), key=str)
    assert found == sorted(((i, u, t, *brute_url(u, t, entries)) for i, u, t in captures), key=str)


def test_empty_list_and_captures(spark):
    none = spark.createDataFrame([], "pattern string, action string, effective timestamp")
    caps = spark.createDataFrame([(1, "http://a.b", dt.datetime(2024, 1, 1))], "page_id long, u string, t timestamp")
    assert [r["blocked"] for r in judge_captures(caps, none, "page_id", "u", "t").collect()] == [False]
    assert judge_captures(caps.limit(0), none, "page_id", "u", "t").count() == 0


def test_entries_of_any_depth_are_met(spark):
    day = dt.datetime(2024, 1, 1)
    deep = "a.b/" + "/".join(f"p{i}" for i in range(40))
    entries = [("a.b/x/y/z", "block", day), ("a.b/x", "allow", day), (deep, "block", day), ("a.b/p0/p1/p2", "allow", day), ("b", "block", day)]
    urls = {
        "http://a.b/x/y/z": "a.b/x/y/z", "http://a.b/x//y/z/w?q=/x": "a.b/x/y/z", "http://a.b/x/y": "a.b/x", "http://a.b/q/x/y/z": "b",
        f"https://{deep}/more": deep, "https://" + deep.rsplit("/", 1)[0]: "a.b/p0/p1/p2", "http://c.d/x/y/z": None, "": None,
    }
    caps = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, u string, t timestamp")
    listed = spark.createDataFrame(entries, "pattern string, action string, effective timestamp")
    got = judge_captures(caps, listed, "page_id", "u", "t").collect()
    actions = {p: a for p, a, _ in entries}
    assert {r["u"]: (r["pattern"], r["action"], r["blocked"]) for r in got} == {u: (p, actions.get(p), actions.get(p) == "block") for u, p in urls.items()}
