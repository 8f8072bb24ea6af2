"""Near duplicates against all pairs of plain Python sets."""

import random
import re

from pyspark.sql import functions as F

from echorank.llm.neardup import near_duplicates
from echorank.llm.neardup_queries import op8_circulant_minhash

SF = "/root/testdata/sf0.001"
SPACE = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                if 100 * len(a & b) >= percent * len(a | b):
                    label[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows, size, percent=80):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs.withColumn("component", F.lit("x")).withColumn("band", F.lit(1)), size, percent).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op8_circulant_minhash(spark, SF).collect()), key=str)
    assert got == brute(rows, 4, 80)


def test_chains_copies_and_borders(spark):
    size = 5
    rng = random.Random(size)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(70):  # a drifting chain: neighbours are linked, far members are not
        base = list(base)
        base[rng.randrange(60)] = f"x{i}"
        rows.append((1000 - i, " ".join(base)))
    star = [f"s{rng.randrange(10**6)}" for _ in range(50)]
    for i in range(40):  # edits of one text, about as many pairs below the bound as above
        w = list(star)
        for _ in range(2):
            w[rng.randrange(50)] = f"y{rng.randrange(10**6)}"
        rows.append((2000 + i, "\t".join(w)))
    rows += [(7, "one two"), (5, "ONE  two"), (9, "one"), (11, ""), (12, None), (13, " \n"), (13, " \n"), (None, "one two")]
    rows += [(3, "a b c d e f g")] * 3 + [(4, "A b c d e f g")]
    rows += [(20, "long " * 20000), (21, "long " * 20001 + "end")]
    assert run(spark, rows, size) == brute(rows, size, 80)


def test_empty_table(spark):
    assert run(spark, [], 5) == []
