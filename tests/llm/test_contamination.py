"""Suffix-array matches against all windows in plain Python."""

import random
import re

from pyspark.sql import functions as F

from echorank.llm import contamination as C

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for doc, text in docs:
        w, hit, named, longest = words(text), set(), set(), 0
        for item, body in items:
            b = words(body)
            n = min(13, len(b))
            if item is None or not b:
                continue
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    named.add(str(item))
                    for j in range(len(b)):
                        k = 0
                        while i + k < len(w) and j + k < len(b) and w[i + k] == b[j + k]:
                            k += 1
                        longest = max(longest, k)
        out.append((doc, len(w), len(hit), sorted(named), len(hit) > 0 and 20 * len(hit) >= len(w), longest))
    return sorted(out, key=str)


def case():
    rng = random.Random(5)
    names = [f"w{i}" for i in range(40)] + ["Été", "ß"]
    say = lambda n: " ".join(rng.choice(names) for _ in range(n))
    items = [(i, say(rng.randrange(14, 40))) for i in range(12)]
    items += [(100, "One two, three"), (101, "solo"), (102, ""), (103, None), (None, say(20)), (104, "a " * 30), (3, items[3][1]), (105, items[4][1])]
    docs = []
    for i in range(60):
        parts = [say(rng.randrange(0, 60))]
        if i % 2:
            b = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(b) - 12)
            parts.append("; ".join(b[a : a + rng.randrange(11, 20)]).upper().replace("SS", "ß"))
        docs.append((i, " ".join([*parts, say(rng.randrange(0, 30))])))
    docs += [(200, None), (201, ""), (202, "one TWO three"), (203, "a " * 500), (204, "solo"), (None, items[5][1]), (205, items[0][1]), (205, items[0][1])]
    docs += [(206, items[1][1] + " " + say(20000)), (207, items[1][1][:-4] + "\n" + items[1][1])]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("matches", F.lit("mine")).withColumn("matches_n", F.lit(1)).withColumn("row", F.lit("r"))
    t = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = C.contamination(d, t).collect()
    kept = C.decontaminate(d, t)
    assert kept.columns == d.columns
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"], r["longest"]) for r in got]
    left = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert left == sorted((r[0] for r in rows if not r[4]), key=str)
    by_item, by_doc = dict(items), dict(docs)
    for r in got:
        if r["longest"] and r["doc_id"] is not None:
            w, b, n = words(by_doc[r["doc_id"]]), words(by_item[int(r["longest_item"])]), r["longest"]
            assert w[r["longest_doc_word"] :][:n] == b[r["longest_item_word"] :][:n]
    return sorted(rows, key=str)


def test_against_all_windows(spark):
    docs, items = case()
    assert run(spark, docs, items) == brute(docs, items)


def test_in_blocks_of_items(spark, monkeypatch):
    docs, items = case()
    monkeypatch.setattr(C, "ITEM_BLOCK_BYTES", 900)
    assert C.n_blocks(spark.createDataFrame(items, "item_id long, text string")) > 2
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = case()
    assert run(spark, docs[:3], []) == brute(docs[:3], [])
    assert run(spark, [], items) == []
    assert run(spark, docs[:3], [(1, None)]) == brute(docs[:3], [])
