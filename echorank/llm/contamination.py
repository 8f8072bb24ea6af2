"""Benchmark decontamination with suffix arrays over the training texts.

Each task sorts the suffixes of its shard of whole training texts, a few megabytes
at a time, and binary-searches every suffix of the test items in it. A test window is
13 consecutive words of an item (an item of fewer words is one window); the range of
suffixes that begin with it are its verbatim occurrences, with their places. From
each of them the match is extended to the longest one, which starts at the same word
and has one of its two neighbours among the sorted test suffixes.

Only suffixes that can match are kept: a word that no item has ends every match, so
runs of item words shorter than the shortest window are left out of the array. That
changes no result. Sorting doubles the compared length up to the longest item.

The items are sent to the tasks in blocks of bounded size, one pass over the texts
for each; a usual benchmark is one block. The driver holds one block at a time.

Defined results: NULL texts have no words; items with a NULL id or text, or without
words, take no part; repeated items and windows count once; repeated documents each
give a row; without items or documents nothing is contaminated, or there is no row.
Words are compared as 64-bit hashes (see ``words``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echorank.llm.tables import free_name, received, send, written
from echorank.llm.words import ALNUM, Hasher, Words, cut, slices

WINDOW = 13
#: Bytes of text in one suffix array, and of item text sent to the tasks together.
SHARD_BYTES, ITEM_BLOCK_BYTES = 16 << 20, 32 << 20

RESULT = (
    "n_words long, item_ids array<string>, hit_runs array<struct<start:long,stop:long>>, longest long, longest_item string,"
    " longest_item_word long, longest_doc_word long"
)


def doubled(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``codes`` sorted by the ``depth`` codes (or more) from there on."""
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    order, rank, step = np.argsort(rank, kind="stable"), rank.astype(np.int64) + 1, 1
    while step < depth and n:
        key = rank * (n + 1)
        key[: n - step] += rank[step:]
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        fresh = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        rank[order] = np.cumsum(fresh)
        if fresh.all():
            break
        step *= 2
    return order


def common(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many codes agree from ``a[at]`` and ``b[bt]`` on, ``most`` at most."""
    n, open_, d = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(open_):
        open_ = open_[d < most[open_]]
        open_ = open_[a[at[open_] + d] == b[bt[open_] + d]]
        n[open_] += 1
        d += 1
    return n


@dataclass
class Items:
    """Test items as word codes: one flat array with a 0 after each item."""

    vocabulary: np.ndarray  # sorted hashes; code = place + 1
    seen: np.ndarray  # which low bits occur in it
    codes: np.ndarray
    item: np.ndarray  # per place in codes: number of the item
    names: list[str]
    start: np.ndarray  # distinct windows: a place in codes, length, and their items
    length: np.ndarray
    owners: list[np.ndarray]
    suffixes: np.ndarray  # places of all test suffixes in sorted order
    left: np.ndarray  # per place in codes: words to the item's end
    longest: int

    @classmethod
    def of(cls, ids: list[str], texts: list[str]) -> Items:
        words = cut(pa.array(texts, pa.large_string()), ALNUM, Hasher())
        vocabulary = np.unique(words.hashes)
        code = np.searchsorted(vocabulary, words.hashes).astype(np.int64) + 1
        names = sorted(set(ids))
        number = {x: i for i, x in enumerate(names)}
        pieces, item, left, longest, windows = [], [], [], 0, {}
        place = 0
        for x, a, b in zip(ids, words.first[:-1].tolist(), words.first[1:].tolist()):
            n = b - a
            if not n:
                continue
            pieces += [code[a:b], [0]]
            item.append(np.full(n + 1, number[x]))
            left.append(np.arange(n, -1, -1))
            w = min(n, WINDOW)
            for j in range(n - w + 1):
                windows.setdefault(code[a + j : a + j + w].tobytes(), (place + j, w, set()))[2].add(number[x])
            place, longest = place + n + 1, max(longest, n)
        codes = np.concatenate([*pieces, [0]]).astype(np.int64)
        left = np.concatenate([*left, [0]]).astype(np.int64)
        seen = np.zeros(1 << 20, bool)
        seen[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        order = doubled(codes, longest)
        return cls(
            vocabulary, seen, codes, np.concatenate([*item, [0]]).astype(np.int64), names,
            np.array([x[0] for x in windows.values()], np.int64), np.array([x[1] for x in windows.values()], np.int64),
            [np.array(sorted(x[2]), np.int64) for x in windows.values()], order[left[order] > 0], left, longest,
        )

    def coded(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words occur in an item, and their codes."""
        at = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[place] == hashes[at]
        return at[same], place[same].astype(np.int64) + 1


class Shard:
    """The suffix array of some texts: only runs of item words as long as a window."""

    def __init__(self, words: Words, items: Items):
        at, code = items.coded(words.hashes)
        if len(at):
            doc = np.searchsorted(words.first, at, "right")
            cut_ = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc) != 0)) + 1
            begin, size = np.concatenate(([0], cut_)), np.diff(np.concatenate(([0], cut_, [len(at)])))
            keep = np.repeat(size >= items.length.min(), size)
            run = np.repeat(np.arange(len(begin)), size)[keep]
            at, code = at[keep], code[keep]
            gap = np.cumsum(np.concatenate(([0], np.diff(run) != 0))) if len(at) else at
        else:
            gap = at
        self.codes = np.zeros(len(at) + int(gap[-1] if len(at) else 0) + 2, np.int64)
        self.word = np.full(len(self.codes), -1, np.int64)
        self.codes[np.arange(len(at)) + gap], self.word[np.arange(len(at)) + gap] = code, at
        order = doubled(self.codes, items.longest)
        self.suffixes = order[self.codes[order] > 0]

    def bound(self, items: Items, start: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        """First suffix not below (or, ``after``, beyond) each test sequence."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.suffixes), np.int64)
        while len(active := np.flatnonzero(lo < hi)):
            mid = (lo[active] + hi[active]) >> 1
            at, bt = self.suffixes[mid], start[active]
            n = common(self.codes, at, items.codes, bt, length[active])
            full = n == length[active]
            below = np.where(full, after, self.codes[at + n] < items.codes[bt + n])
            lo[active[below]] = mid[below] + 1
            hi[active[~below]] = mid[~below]
        return lo


def matches(words: Words, items: Items) -> pa.StructArray:
    """Per text its words, the items found in it, the hit runs and the longest match."""
    docs = len(words.first) - 1
    n_words = np.diff(words.first)
    shard = Shard(words, items)
    lo = shard.bound(items, items.start, items.length, False)
    hi = shard.bound(items, items.start, items.length, True)
    found = np.flatnonzero(hi > lo)
    count = (hi - lo)[found]
    ends = np.cumsum(count)
    rank = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(lo[found], count)
    window = np.repeat(found, count)
    place = shard.suffixes[rank]
    word = shard.word[place]
    doc = np.searchsorted(words.first, word, "right") - 1

    edge = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + items.length[window], -1)
    hit = np.cumsum(edge[:-1]) > 0
    before = np.concatenate(([False], hit[:-1]))
    new = hit & ~before
    new[words.first[:-1][n_words > 0]] |= hit[words.first[:-1][n_words > 0]]
    begin = np.flatnonzero(new)
    stop = hit & ~np.concatenate((hit[1:], [False]))
    last = words.first[1:][n_words > 0] - 1
    stop[last] |= hit[last]
    stop = np.flatnonzero(stop) + 1
    run_doc = np.searchsorted(words.first, begin, "right") - 1
    per_doc = np.searchsorted(run_doc, np.arange(docs + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays(
        [pa.array(begin - words.first[run_doc]), pa.array(stop - words.first[run_doc])], ["start", "stop"]
    )

    pair = np.unique(doc * len(items.start) + window)
    owners = [items.owners[w] for w in (pair % len(items.start)).tolist()]
    owned = np.repeat(pair // len(items.start), [len(o) for o in owners])
    pair = np.unique(owned * len(items.names) + (np.concatenate(owners) if owners else np.zeros(0, np.int64)))
    item_of = np.searchsorted(pair // len(items.names), np.arange(docs + 1)).astype(np.int32)
    names = [items.names[i] for i in (pair % len(items.names)).tolist()]

    # The longest match from a place has one of the two neighbours among test suffixes.
    begins = shard.bound(items, items.suffixes, items.left[items.suffixes], False)
    near = np.searchsorted(begins, rank, "right")
    best, where = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    for side in (near - 1, near):
        ok = np.flatnonzero((side >= 0) & (side < len(items.suffixes)))
        test = items.suffixes[side[ok]]
        n = common(shard.codes, place[ok], items.codes, test, items.left[test])
        more = n > best[ok]
        best[ok[more]], where[ok[more]] = n[more], test[more]
    top = np.lexsort((word, -best, doc))
    top = top[np.concatenate(([True], np.diff(doc[top]) != 0))] if len(top) else top
    long_, l_item, l_at, l_word = (np.zeros(docs, np.int64) for _ in range(4))
    long_[doc[top]], l_item[doc[top]], l_word[doc[top]] = best[top], items.item[where[top]], word[top] - words.first[doc[top]]
    size = np.bincount(items.item[items.left > 0], minlength=len(items.names))
    l_at[doc[top]] = size[items.item[where[top]]] - items.left[where[top]]
    none = long_ == 0
    label = pa.array([None if z else items.names[i] for z, i in zip(none.tolist(), l_item.tolist())], pa.string())
    return pa.StructArray.from_arrays(
        [
            pa.array(n_words.astype(np.int64)),
            pa.ListArray.from_arrays(item_of, pa.array(names, pa.string())),
            pa.ListArray.from_arrays(per_doc, runs),
            pa.array(long_), label, pa.array(l_at, mask=none), pa.array(l_word, mask=none),
        ],
        ["n_words", "item_ids", "hit_runs", "longest", "longest_item", "longest_item_word", "longest_doc_word"],
    )


def n_blocks(items: DataFrame) -> int:
    """In how many parts the items are sent to the tasks."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    return 1 if total <= ITEM_BLOCK_BYTES else -(-2 * total // ITEM_BLOCK_BYTES)


def item_block(items: DataFrame, k: int, blocks: int) -> Items:
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), "text"
    )
    some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().collect()
    return Items.of([r["item_id"] for r in some], [r["text"] for r in some])


def with_matches(docs: DataFrame, items: Items, name: str) -> DataFrame:
    """``docs`` with one more column ``name``: the matches with one block of items."""
    sent = send(docs.sparkSession, items)

    def task(batches):
        hasher, tests = Hasher(), received(sent)
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                words = cut(part.column("text"), ALNUM, hasher)
                if len(tests.start):
                    found = matches(words, tests)
                else:
                    found = pa.array(
                        [{"n_words": n, "item_ids": [], "hit_runs": [], "longest": 0} for n in np.diff(words.first).tolist()], arrow
                    )
                yield pa.RecordBatch.from_arrays([*part.columns, found.cast(arrow)], [*part.schema.names, name])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = T.StructType.fromDDL(RESULT)
    arrow = to_arrow_type(kind)
    return docs.mapInArrow(task, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def hit_words(runs: Column) -> Column:
    """Words in any of the runs, which may overlap."""
    ordered = F.sort_array(runs)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        ordered,
        start,
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), r["stop"] - F.greatest(a["end"], r["start"]))).alias("n"),
            F.greatest(a["end"], r["stop"]).alias("end"),
        ),
    )["n"]


def _marked(docs: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """``docs`` with the matches of all items in the column ``name``.

    Beyond one block of items the rows are numbered and written once; every pass gives
    matches by number, and only the joined matches meet the rows again.
    """
    blocks = n_blocks(items)
    if blocks == 1:
        return with_matches(docs, item_block(items, 0, 1), name)
    row, parts = free_name([*docs.columns, name], "row"), None
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "contamination-rows")
    for k in range(blocks):
        found = with_matches(numbered.select(row, "text"), item_block(items, k, blocks), name).select(row, name)
        part = written(found, "contamination-block")
        parts = part if parts is None else parts.unionByName(part)
    m = F.col(name)
    joined = parts.groupBy(row).agg(
        F.struct(
            F.max(m["n_words"]).alias("n_words"),
            F.array_distinct(F.flatten(F.collect_set(m["item_ids"]))).alias("item_ids"),
            F.array_distinct(F.flatten(F.collect_set(m["hit_runs"]))).alias("hit_runs"),
            *[F.max_by(m[c], m["longest"]).alias(c) for c in ("longest", "longest_item", "longest_item_word", "longest_doc_word")],
        ).alias(name),
    )
    return numbered.join(joined, row).select(*docs.columns, name)


def _verdict(m: Column) -> tuple[Column, Column]:
    hits = hit_words(m["hit_runs"])
    return hits, (hits > 0) & (20 * hits >= m["n_words"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, item_ids, contaminated`` and the longest match.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and ``text``.
    ``item_ids`` are sorted as strings. The longest match gives its words, the item,
    and the first word in the item and in the document, counted from 0.
    """
    m = F.col("m")
    hits, bad = _verdict(m)
    return _marked(docs.select("doc_id", "text"), items.select("item_id", "text"), "m").select(
        "doc_id",
        m["n_words"].alias("n_words"),
        hits.alias("n_hit"),
        F.array_sort(m["item_ids"]).alias("item_ids"),
        bad.alias("contaminated"),
        *[m[c].alias(c) for c in ("longest", "longest_item", "longest_item_word", "longest_doc_word")],
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents, all columns kept."""
    name = free_name(docs.columns, "matches")
    marked = _marked(docs, items.select("item_id", "text"), name)
    return marked.where(~_verdict(F.col(name))[1]).select(*docs.columns)
