"""Byte-level BPE in padded numpy matrices, and back.

The pieces of a batch (matches of the splitting pattern) are made distinct, sorted
by length into buckets, and each bucket is a matrix with one piece a row, padded with
-1. A round looks up every adjacent pair of every row in a hash table of pair ranks
and merges the leftmost pair of the smallest rank in each row; then rows are
compacted by one column, and finished rows leave the matrix. Memory is bounded by
``CELLS`` numbers a matrix, whatever the number of pieces; a long piece is a bucket of
its own, processed with a heap of its pairs, since a round per merge over its whole
row would cost the square of its length.

Defined results: a NULL text is empty and has no tokens; decoding gives the UTF-8
bytes of the text again. Ids that the vocabulary does not have cannot be decoded and
raise an error.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echorank.llm.lookup import Places, gather
from echorank.llm.tables import free_name
from echorank.llm.words import slices

#: Numbers in one matrix, bytes from which a piece is merged with a heap, and text cut together.
CELLS, LONG_PIECE, SLICE = 1 << 20, 256, 4 << 20
#: Distinct pieces whose ids a task keeps from batch to batch.
KEPT_PIECES = 200_000
NO_RANK = np.int32(2**31 - 1)


class Vocabulary:
    """Token bytes by id, and the rank and id of every pair of ids that merges."""

    def __init__(self, lines: list[bytes]):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.present = np.zeros(len(self.tokens), bool)
        self.present[list(ranks.values())] = True
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        lefts, rights, made = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):  # any two tokens that join to a token may merge
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    lefts.append(a), rights.append(b), made.append(rank)
        self.pairs = Places((np.array(lefts, np.uint64) << np.uint64(32)) | np.array(rights, np.uint64))
        self.made = np.array(made, np.int32)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NO_RANK`` where it does not merge or an id is -1."""
        place = self.pairs((left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64))
        return np.where((place >= 0) & (left >= 0) & (right >= 0), self.made[place], NO_RANK)

    def merge_matrix(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row merged to the end: the ids, padded with -1, and their number."""
        out, sizes = rows.copy(), (rows >= 0).sum(axis=1)
        live = np.arange(len(rows))
        ids = rows
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while ids.shape[1] > 1 and len(ids):
            best = ranks.argmin(axis=1)  # the leftmost of the smallest
            r = np.arange(len(ids))
            rank = ranks[r, best]
            merging = rank != NO_RANK
            if not merging.all():
                done = ~merging
                out[live[done], : ids.shape[1]] = ids[done]
                sizes[live[done]] = (ids[done] >= 0).sum(axis=1)
                live, ids, ranks, best, rank = live[merging], ids[merging], ranks[merging], best[merging], rank[merging]
                if not len(ids):
                    return out, sizes
                r = np.arange(len(ids))
            # Compact: everything right of the merged pair moves one place to the left.
            column = np.arange(ids.shape[1] - 1)
            take = column + (column > best[:, None])
            ids = np.take_along_axis(ids, take, axis=1)
            ids[r, best] = rank
            if ids.shape[1] == 1:
                break
            ranks = np.take_along_axis(ranks, take[:, :-1] + (column[:-1] == best[:, None]), axis=1)
            for side in (best - 1, best):  # only the two pairs beside the merge are new
                ok = np.flatnonzero((side >= 0) & (side < ids.shape[1] - 1))
                ranks[ok, side[ok]] = self.pair_ranks(ids[ok, side[ok]], ids[ok, side[ok] + 1])
            width = int((ids >= 0).sum(axis=1).max())
            ids, ranks = ids[:, :width], ranks[:, : max(width - 1, 0)]
        if len(ids):
            out[live] = -1
            out[live, : ids.shape[1]] = ids
            sizes[live] = (ids >= 0).sum(axis=1)
        return out, sizes

    def merge_long(self, piece: bytes) -> np.ndarray:
        """A long piece, with a heap of (rank, place) in place of rounds over the row."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NO_RANK)]
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(piece)
        before, after, rank_at = list(range(-1, n - 1)), list(range(1, n + 1)), first.tolist()
        one = lambda a, b: int(self.pair_ranks(np.array([a]), np.array([b]))[0])
        memo: dict[tuple[int, int], int] = {}
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or after[i] >= n or rank_at[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    pair = ids[k], ids[after[k]]
                    if pair not in memo:
                        memo[pair] = one(*pair)
                    rank_at[k] = memo[pair]
                    if rank_at[k] != NO_RANK:
                        heapq.heappush(heap, (rank_at[k], k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in one array and their numbers; like lengths share a matrix."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(lengths, kind="stable")
        sorted_ = lengths[order]
        n_short = int(np.searchsorted(sorted_, LONG_PIECE, "right"))
        flats, sizes, i = [], [], 0
        while i < n_short:
            width = int(sorted_[i])
            j = int(np.searchsorted(sorted_[:n_short], width + width // 8, "right"))
            j = min(j, i + max(1, CELLS // max(1, width)))
            width = int(sorted_[j - 1])
            rows = np.full((j - i, width), -1, np.int32)
            joined = np.frombuffer(b"".join([pieces[k] for k in order[i:j].tolist()]), np.uint8)
            rows[np.arange(width) < sorted_[i:j, None]] = self.of_byte[joined]
            ids, n = self.merge_matrix(rows)
            flats.append(ids[np.arange(width) < n[:, None]]), sizes.append(n)
            i = j
        for k in order[n_short:].tolist():
            flats.append(self.merge_long(pieces[k])), sizes.append(np.array([len(flats[-1])]))
        flat, size = np.concatenate([np.zeros(0, np.int32), *flats]), np.concatenate([np.zeros(0, np.int64), *sizes])
        place = np.argsort(order)
        return gather(flat, (np.cumsum(size) - size)[place], size[place]), size[place]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens) or not self.present[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return gather(self.flat, self.begins[ids], self.sizes[ids])


class Encoder:
    """Splits texts, encodes their distinct pieces, keeps pieces for the next batch."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # piece: its place in begins and sizes
        self.flat, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the number of each text's ids."""
        pieces, ends = [], []
        for t in texts:
            if t:
                pieces += self.split(t)
            ends.append(len(pieces))
        if len(self.known) > KEPT_PIECES:
            self.forget()
        new = list(set(pieces).difference(self.known))
        flat, sizes = self.vocabulary.encode_pieces([p.encode() for p in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(sizes) - sizes))
        self.flat, self.sizes = np.concatenate((self.flat, flat)), np.concatenate((self.sizes, sizes))
        place = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        size = self.sizes[place]
        total = np.concatenate(([0], np.cumsum(size)))[np.array([0, *ends], np.int64)]
        return gather(self.flat, self.begins[place], size), np.diff(total)


def vocabulary_lines(path: str) -> list[bytes]:
    """The rank file, read once on the driver and sent to the tasks (less than 1 MB)."""
    with open(path, "rb") as f:
        return f.read().splitlines()


def encode(
    docs: DataFrame, path: str, pattern: str, keep: list[str], name: str = "ids",
    derive: tuple[list[T.StructField], Callable] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``name``, the token ids of ``text``.

    ``derive`` is a pair of fields and a function of (vocabulary, ids of a row) that
    gives their values in place of the ids, for digests that need no id column.
    """
    lines = docs.sparkSession.sparkContext.broadcast(vocabulary_lines(path))
    kept = docs.select(*keep).schema.fields
    fields = derive[0] if derive else [T.StructField(name, T.ArrayType(T.IntegerType()))]

    def task(batches):
        vocabulary = Vocabulary(lines.value)
        encoder = Encoder(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, len(kept), SLICE):
                flat, sizes = encoder(part.column(len(kept)).to_pylist())
                ends = np.cumsum(sizes)
                columns = [part.column(i) for i in range(len(kept))]
                if derive:
                    rows = [derive[1](vocabulary, flat[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                    columns += [pa.array(list(c)) for c in zip(*rows)]
                else:
                    offsets = np.concatenate(([0], ends)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in [*kept, *fields]])

    return docs.select(*keep, F.col("text").alias(free_name(keep, "text"))).mapInArrow(task, T.StructType([*kept, *fields]))


def decode(tokens: DataFrame, path: str, keep: list[str], ids: str = "ids", name: str = "text") -> DataFrame:
    """The columns ``keep`` and ``name``, the text of an id column; NULL ids are empty."""
    lines = tokens.sparkSession.sparkContext.broadcast(vocabulary_lines(path))
    kept = tokens.select(*keep).schema.fields

    def task(batches: Iterator[pa.RecordBatch]):
        vocabulary = Vocabulary(lines.value)
        for batch in batches:
            rows = batch.column(len(kept)).to_pylist()
            texts = [vocabulary.decode(np.array(r or [], np.int64)).tobytes().decode("utf-8", "replace") for r in rows]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*[f.name for f in kept], name])

    return tokens.select(*keep, F.col(ids).alias(free_name(keep, "ids"))).mapInArrow(task, T.StructType([*kept, T.StructField(name, T.StringType())]))
