"""Conversation repair against plain searches over all edits."""

import hashlib
import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from echorank.llm import dialogue
from echorank.llm.dialogue_queries import damaged

SCHEMA = "conv_id long, turn long, role string, text string, g long, conv string, kind string, audit int"
NEXT = {"": "u", "s": "u", "a": "u", "u": "a"}


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """The least (cost, audit) over all edit sequences."""

    @lru_cache(None)
    def best(i, state, inserts):
        out = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            cost, audit = best(i, NEXT[state], inserts + 1)
            out.append((cost + 3, "I" + audit))
        if i < len(rows):
            cost, audit = best(i + 1, state, 0)
            out.append((cost + 4, "D" + audit))
            if found[i] in ("", "truncated"):
                more, initial = 3 * (found[i] == "truncated"), rows[i][0][:1]
                cost, audit = best(i + 1, NEXT[state], 0)
                out.append((cost + 3 + more, "R" + audit))
                if initial == NEXT[state] or (initial, state) == ("s", ""):
                    cost, audit = best(i + 1, initial, 0)
                    out.append((cost + more, "K" + audit))
        return min(out, default=(10**9, ""))

    return best(0, "", 0)


def apply(rows, audit):
    out, i = [], 0
    for e in audit:
        last = out[-1][0][0] if out else ""
        name = {"u": "user", "a": "assistant"}[NEXT[last]]
        if e in "KR":
            out.append((rows[i][0] if e == "K" else name, rows[i][1]))
        if e == "I":
            out.append((name, ""))
        i += e != "I"
    return out


def plain(table):
    """Facts and repaired rows of each conversation."""
    out = {}
    for conv in {r[0] for r in table}:
        mine = sorted(
            ((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in table if c == conv),
            key=lambda m: (m[0], m[1], m[2].encode(), m[3][:32].encode(), hashlib.md5(m[3].encode()).hexdigest()),
        )
        rows, turns = [m[2:] for m in mine], {m[1] for m in mine if m[0]}
        found = faults(rows)
        cost, audit = cheapest(tuple(rows), tuple(found))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gap = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        facts = (gap, *[found.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit)
        out[conv] = (facts, apply(rows, audit))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out[conv][1]))
    return out


def run(spark, table):
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in table], SCHEMA)
    facts, fixed = dialogue.repair(df, "conv_id", "turn", "role", "text")
    got = {r["conv"]: tuple(r)[1:] for r in facts.collect()}
    sha = {r["conv"]: r["sha256"] for r in dialogue.digests(fixed).collect()}
    rows = {}
    for r in fixed.collect():
        rows.setdefault(r["conv"], []).append((r["role"], r["text"]))
    return {c: (got[c], rows.get(c, [])) for c in got}, sha


def check(spark, table):
    got, sha = run(spark, table)
    want = plain(table)
    assert got == want
    assert sha == {c: hashlib.sha256("\n".join(f"{r}:{x}" for r, x in rows).encode()).hexdigest() for c, (_, rows) in want.items() if rows}


def some(rng, conv):
    texts = ["Hi.", "What?", "cut off", "", "  \t", "Yes!", "more", None, "Long " * 50 + ".", "x.\n"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "Ursula", "uncle"]
    return [(conv, rng.choice([*range(9), None]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 14))]


def test_equals_all_edits(spark):
    rng = random.Random(7)
    table = [row for conv in range(250) for row in some(rng, conv)] + some(rng, None)
    check(spark, table + [(900, 1, "user", "One."), (900, 1, "user", "One."), (901, None, None, None), (902, 3, "system", "Only.")])


def test_solver_on_random_symbols():
    rng, blocks = random.Random(1), dialogue.Blocks()
    assert len(blocks.vectors) < 1000
    kinds = ["", "", "", "blank", "duplicate", "truncated"]
    order = ["", "blank", "duplicate", "truncated"]
    for _ in range(3000):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "x"]), "") for _ in range(rng.randint(1, 13))]
        found = [rng.choice(kinds) for _ in rows]
        letters = bytes(65 + 4 * ("xsua".index(r)) + order.index(f) for (r, _), f in zip(rows, found))
        cost, tokens = blocks.solve(letters)
        audit = "".join(tokens).translate(dialogue._AUDIT)
        assert (cost, audit) == cheapest(tuple(rows), tuple(found))


@pytest.mark.parametrize("block", [1, 2, 3])
def test_block_length_does_not_matter(block):
    rng, short, long = random.Random(4), dialogue.Blocks(block), dialogue.Blocks()
    for _ in range(300):
        letters = bytes(65 + rng.randint(0, 15) for _ in range(rng.randint(0, 200)))
        (a, x), (b, y) = short.solve(letters), long.solve(letters)
        assert a == b and list(x) == list(y)


def test_one_very_long_conversation(spark, monkeypatch):
    """Most rows in one conversation, over several partitions and pieces."""
    monkeypatch.setattr(dialogue, "PIECE", 64)
    rng = random.Random(9)
    table = [(1, i, rng.choice(["user", "assistant"]), f"{i}" + rng.choice([".", ""])) for i in range(700)] + [(1, 3, "user", "Same.")] * 300 + [(2, 1, "user", "Hi.")]
    got, sha = run(spark, table)
    rows = [(m[2], m[3]) for m in sorted((r for r in table if r[0] == 1), key=lambda m: (m[1], m[2], m[3][:32], hashlib.md5(m[3].encode()).hexdigest()))]
    found = faults(rows)
    order = ["", "blank", "duplicate", "truncated"]
    letters = bytes(65 + 4 * ("xsua".index(r[0])) + order.index(f) for (r, _), f in zip(rows, found))
    cost, tokens = dialogue.Blocks().solve(letters)
    audit = "".join(tokens).translate(dialogue._AUDIT)
    assert got[1] == ((0, 0, 299, found.count("truncated"), got[1][0][4], cost, audit), apply(rows, audit))
    assert sha[1] == hashlib.sha256("\n".join(f"{r}:{x}" for r, x in apply(rows, audit)).encode()).hexdigest()


def test_nothing(spark):
    assert run(spark, []) == ({}, {})
    got, sha = run(spark, [(1, 1, "user", ""), (1, 2, "user", " ")])
    assert got == {1: ((0, 2, 0, 0, 1, 8, "DD"), [])} and sha == {}


def test_long_text(spark):
    check(spark, [(1, 1, "user", "word " * 400_000 + "end."), (1, 2, "assistant", "x" * 2_000_000)])


def test_damage(spark):
    import zlib

    table = [(c, t, "assistant", "A. B! c?") for c in range(40) for t in (*range(6), None)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in table:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if draw == 4 else role, "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text)
        want += [row] * {0: 0, 3: 2}.get(draw, 1)
    got = damaged(spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumn("draw", F.lit("mine")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
