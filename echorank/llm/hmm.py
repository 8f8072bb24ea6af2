"""A hidden Markov language model over words, trained by Baum-Welch across partitions.

States emit word classes, classes emit words. The ``OWN`` most frequent training words
(and the end of a text) are classes of their own; every other word, seen or not,
belongs to one of ``SHARED`` classes by its last three bytes, where it has its count
plus a half, and all words unseen in training share a half. So the states, their
transitions and the class emissions are of bounded size whatever the vocabulary, and
the model is a distribution over all texts.

The texts are cut once into blocks: token numbers and the block's distinct words. Word
counts are summed over (block, word) rows; an iteration adds up expected transitions
and emissions in every task and sums them by Spark; a block gets the counts of its
words back by a join on the distinct words, so no token is shuffled for itself. The
likelihood of a text is that of the scaled forward recursion over all its tokens.

Training reads all tokens of the training texts, whole: a text longer than ``SEGMENT``
tokens is worked on in pieces, which bounds the memory of the backward recursion, but
products of the pieces' transfer matrices carry the states from piece to piece, so its
expected counts are those of one sequence. Scores are exact for any length too.

Defined results: NULL is an empty text, whose only token is its end; a NULL id counts
as an empty text for its fold; repeated rows each give a row; without training texts
every count is 0 and the classes are equally likely. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echorank.llm.lookup import Places
from echorank.llm.tables import received, send, written
from echorank.llm.words import SPACED, Hasher, cut, mix, slices

STATES, ITERATIONS = 8, 6
OWN, SHARED = 4096, 1024
#: Bytes of text in a block, blocks in a file, tokens of a piece in training, tokens computed together.
BLOCK, BLOCKS_PER_FILE, SEGMENT, CELLS = 16 << 20, 4, 4096, 1 << 18
#: Tokens from one scaling of the recursions to the next, tokens counted together.
EVERY, CHUNK = 4, 1 << 13
END = np.uint64(0)
#: Weight of the overall class shares in each state's emissions.
PRIOR = 1.0


def blocks(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text, held_out)`` as blocks of token numbers with their words."""

    def task(batches):
        hasher, number = Hasher(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                words = cut(part.column("text"), SPACED, hasher)
                size = np.diff(words.first) + 1
                tokens = np.insert(words.hashes, words.first[1:], END)
                held = np.asarray(part.column("held_out").to_pylist(), bool)
                unique, at, inverse, n = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
                common = np.argsort(-n, kind="stable")  # small numbers for frequent words
                place = np.empty(len(common), np.int32)
                place[common] = np.arange(len(common), dtype=np.int32)
                inverse = place[inverse]
                train = np.bincount(inverse, np.repeat(~held, size), len(unique)).astype(np.int64)
                text = np.searchsorted(np.cumsum(size), at, "right")
                word = np.minimum(at - text, max(0, len(words.starts) - 1))
                tail = np.zeros(len(unique), np.uint64)
                if len(words.starts):
                    for k in range(3):
                        spot = words.ends[word] - 1 - k
                        tail = (tail << np.uint64(8)) | np.where(spot >= words.starts[word], words.data[np.maximum(spot, 0)], 0).astype(np.uint64)
                shared = (mix(tail) % np.uint64(SHARED)).astype(np.int32)
                one = lambda a, kind: pa.ListArray.from_arrays(np.array([0, len(a)], np.int32), pa.array(a, kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        one(part.column("doc_id"), pa.int64()),
                        one(held, pa.bool_()),
                        one(size, pa.int64()),
                        pa.array([inverse.tobytes()], pa.binary()),
                        one(unique[common].view(np.int64), pa.int64()),
                        one(train, pa.int64()),
                        one(shared[common], pa.int32()),
                    ],
                    ["block", "doc_ids", "held", "sizes", "tokens", "words", "train", "shared"],
                )
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(
        task,
        "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, tokens binary, words array<long>,"
        " train array<long>, shared array<int>",
    )


def flat(column: pa.ListArray, row: int) -> np.ndarray:
    return np.asarray(column[row].values)


@dataclass
class Vocabulary:
    """The words with classes of their own, and the sizes of the shared classes."""

    own: np.ndarray  # hashes
    own_count: np.ndarray
    mass: np.ndarray  # per shared class: counts plus halves
    tokens: int  # N
    kinds: int  # V

    def __post_init__(self):
        self.places = Places(self.own)

    @property
    def classes(self) -> int:
        return len(self.own) + SHARED

    def share(self) -> np.ndarray:
        """Overall share of each class."""
        all_ = np.concatenate((self.own_count + 0.5, self.mass))
        return all_ / all_.sum()

    def class_of(self, words: np.ndarray, shared: np.ndarray) -> np.ndarray:
        place = self.places(words)
        return np.where(place >= 0, place, len(self.own) + shared).astype(np.int32)


def word_rows(coded: DataFrame, without: Vocabulary | None = None) -> DataFrame:
    """``block, place, word, train, shared``: the distinct words of every block."""
    sent = send(coded.sparkSession, without)

    def task(batches):
        skip = received(sent)
        for batch in batches:
            for i in range(batch.num_rows):
                words = flat(batch.column("words"), i)
                place = np.arange(len(words), dtype=np.int32)
                if skip is not None:
                    place = place[skip.places(words.view(np.uint64)) < 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(place), batch.column("block")[i].as_py(), np.int64)),
                        pa.array(place),
                        pa.array(words[place]),
                        pa.array(flat(batch.column("train"), i)[place]),
                        pa.array(flat(batch.column("shared"), i)[place]),
                    ],
                    ["block", "place", "word", "train", "shared"],
                )

    return coded.select("block", "words", "train", "shared").mapInArrow(
        task, "block long, place int, word long, train long, shared int"
    )


def count_words(coded: DataFrame) -> DataFrame:
    """``word, c, shared`` for every word of the training texts."""
    seen = word_rows(coded).where(F.col("train") > 0)
    return written(seen.groupBy("word").agg(F.sum("train").alias("c"), F.min("shared").alias("shared")), "hmm-counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    end = int(END.astype(np.int64))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.where(F.col("word") != end).orderBy(F.desc("c"), "word").limit(OWN).collect()
    ends = counts.where(F.col("word") == end).collect()
    own = np.array([end, *(r["word"] for r in top)], np.int64)
    own_count = np.array([sum(r["c"] for r in ends), *(r["c"] for r in top)], np.int64)
    mass = np.full(SHARED, 0.5)
    for r in counts.groupBy("shared").agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
        mass[r["shared"]] += r["m"]
    for r in top:
        mass[r["shared"]] -= r["c"] + 0.5
    for r in ends:
        mass[r["shared"]] -= r["c"] + 0.5
    return Vocabulary(own.view(np.uint64), own_count, np.maximum(mass, 0.5), int(total["n"]), int(total["v"]))


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def first_model(share: np.ndarray, states: int, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    emit = share[:, None] * np.exp(rng.normal(0, 0.7, (len(share), states)))
    move = np.full((states, states), 0.2 / max(1, states - 1)) + np.eye(states) * 0.6
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def batches_of(size: np.ndarray):
    """Places of sequences of like length, longest first, in groups of bounded size."""
    order, i = np.argsort(-size, kind="stable"), 0
    while i < len(order):
        j = i + max(1, CELLS // max(1, int(size[order[i]])))
        yield order[i:j]
        i = j


@dataclass
class Pieces:
    """Stretches of training texts, with the states before their first and after their last token."""

    begin: np.ndarray
    size: np.ndarray
    first: np.ndarray  # begins its text
    before: np.ndarray  # pieces x states: forward shares at the end of the piece before
    entry: np.ndarray  # the same one move later, the start of the model for a first piece
    leave: np.ndarray  # backward shares at the last token, up to a factor; ones for a last piece


def packed(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Codes of sequences, longest first: all first tokens, then all second ones ...; where each step begins."""
    step = np.arange(int(size[0]))
    live = np.searchsorted(-size, -step, "left")  # sequences longer than t
    at = (begin[None, :] + step[:, None])[np.arange(len(size))[None, :] < live[:, None]]
    return codes[at].astype(np.int64), [0, *np.cumsum(live).tolist()]


def links(model: Model, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per piece, up to a factor, the likelihood of its tokens by the states of the first and the last one."""
    states = len(model.start)
    result, ones = np.empty((len(begin), states, states)), np.ones((states, states))
    for pick in batches_of(size):
        seen, place = packed(codes, begin[pick], size[pick])
        out = np.take(model.emit, seen, axis=0)
        k = len(pick)
        # the first state leads, so that a step is one product and one multiplication
        x, y = np.multiply(np.eye(states)[:, None], out[:k], order="C"), np.empty((states, k, states))
        for t in range(1, len(place) - 1):
            if k != place[t + 1] - place[t]:
                n, k = k, place[t + 1] - place[t]
                result[pick[k:n]] = x[:, k:].transpose(1, 0, 2)
                x, y = np.ascontiguousarray(x[:, :k]), np.empty((states, k, states))
            np.dot(x.reshape(-1, states), model.move, out=y.reshape(-1, states))
            y *= out[place[t] : place[t + 1]]
            if t % 8 == 0:
                y /= y.sum(axis=0) @ ones
            x, y = y, x
        result[pick[:k]] = x.transpose(1, 0, 2)
    return result / result.sum(axis=(1, 2), keepdims=True)


def pieces(model: Model, codes: np.ndarray, size: np.ndarray, pick: np.ndarray) -> Pieces:
    """The picked texts of a block in pieces of at most ``SEGMENT`` tokens."""
    begin, size = (np.cumsum(size) - size)[pick], size[pick]
    parts = -(-size // SEGMENT)
    head = np.cumsum(parts) - parts
    number = np.arange(parts.sum()) - np.repeat(head, parts)
    at, length = np.repeat(begin, parts) + number * SEGMENT, np.minimum(SEGMENT, np.repeat(size, parts) - number * SEGMENT)
    states = len(model.start)
    before, entry, leave = np.zeros((len(at), states)), np.tile(model.start, (len(at), 1)), np.ones((len(at), states))
    long = np.flatnonzero(np.repeat(parts, parts) > 1)
    if len(long):
        link = links(model, codes, at[long], length[long])
        place = np.full(len(at), -1)
        place[long] = np.arange(len(long))
        for j in range(1, int(parts.max())):
            now = head[parts > j] + j
            a = np.einsum("wi,wij->wj", entry[now - 1], link[place[now - 1]])
            before[now] = a / a.sum(axis=1, keepdims=True)
            entry[now] = before[now] @ model.move
        for j in range(int(parts.max()) - 1, 0, -1):
            now = head[parts > j] + j
            v = np.einsum("wij,wj->wi", link[place[now]], leave[now]) @ model.move.T
            leave[now - 1] = v / v.sum(axis=1, keepdims=True)
    return Pieces(at, length, number == 0, before, entry, leave)


def forward(model: Model, entry: np.ndarray, place: list[int], out: np.ndarray, alpha: np.ndarray, total: np.ndarray) -> None:
    """Forward shares of packed sequences by their emissions ``out``, into ``alpha``.

    Every ``EVERY`` tokens they are scaled to a sum of one, and ``out`` by the same; the
    scales' logarithms are added to ``total``.
    """
    ones = np.ones_like(model.move)
    for t in range(len(place) - 1):
        i, j = place[t], place[t + 1]
        a = alpha[i:j]
        if t:
            before = place[t - 1]
            np.dot(alpha[before : before + j - i], model.move, out=a)
        else:
            a[:] = entry
        a *= out[i:j]
        if t % EVERY == 0:
            s = a @ ones  # each state has the sum: products of small matrices are quicker than sums of short rows
            a /= s
            out[i:j] /= s
            total[: j - i] += np.log10(s[:, 0])


def expected(model: Model, codes: np.ndarray, texts: Pieces, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> float:
    """Adds the expected counts of some texts; their log10 likelihood."""
    total, states, back = 0.0, len(model.start), np.ascontiguousarray(model.move.T)
    picks = list(batches_of(texts.size))
    most = max((int(texts.size[pick].sum()) for pick in picks), default=0)
    room = np.empty((4, most, states))
    for pick in picks:
        n, first, leave, width = texts.size[pick], texts.first[pick], texts.leave[pick], len(pick)
        seen, place = packed(codes, texts.begin[pick], n)
        out, alpha, beta, flow = room[:, : len(seen)]
        np.take(model.emit, seen, axis=0, out=out, mode="clip")
        scale = np.zeros(width)
        forward(model, texts.entry[pick], place, out, alpha, scale)
        end = np.array(place)[n - 1] + np.arange(width)
        total += scale.sum() + np.log10(alpha[end].sum(axis=1)).sum()
        beta[end] = leave / (alpha[end] * leave).sum(axis=1, keepdims=True)
        flow[end] = 0  # at a token: the emission and backward share of the next one
        for t in range(len(place) - 2, 0, -1):
            i, j, before = place[t], place[t + 1], place[t - 1]
            f = flow[before : before + j - i]
            np.multiply(out[i:j], beta[i:j], out=f)
            np.dot(f, back, out=beta[before : before + j - i])
        later = np.zeros((states, states))
        for i in range(0, len(seen), CHUNK):
            here = slice(i, i + CHUNK)
            later += alpha[here].T @ flow[here]
            gamma = np.multiply(alpha[here].T, beta[here].T, order="C")
            for s in range(states):
                emitted[s] += np.bincount(seen[here], gamma[s], emitted.shape[1])
        moved += model.move * later
        moved += model.move * (texts.before[pick][~first].T @ (out[:width] * beta[:width])[~first])
        started += (alpha[:width] * beta[:width])[first].sum(axis=0)
    return float(total)


def train(coded: DataFrame, vocabulary: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch: expected counts from every task, summed by Spark in each iteration."""
    share = vocabulary.share()
    model = first_model(share, states)
    for _ in range(iterations):
        sent = send(coded.sparkSession, (vocabulary, model))

        def task(batches, sent=sent):
            words, now = received(sent)
            emitted, moved, started = np.zeros((states, words.classes)), np.zeros((states, states)), np.zeros(states)
            for batch in batches:
                for i in range(batch.num_rows):
                    kind = words.class_of(flat(batch.column("words"), i).view(np.uint64), flat(batch.column("shared"), i))
                    codes = kind[np.frombuffer(batch.column("tokens")[i].as_buffer(), np.int32)]
                    pick = ~np.asarray(batch.column("held")[i].values.to_pylist(), bool)
                    expected(now, codes, pieces(now, codes, flat(batch.column("sizes"), i), pick), emitted, moved, started)
            every = np.concatenate((emitted.ravel(), moved.ravel(), started))
            found = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(every[found])], ["at", "n"])

        rows = coded.select("held", "sizes", "tokens", "words", "shared").mapInArrow(task, "at long, n double")
        found = rows.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        every = np.zeros(states * vocabulary.classes + states * states + states)
        every[np.asarray(found["at"])] = np.asarray(found["n"])
        emitted, moved, started = np.split(every, np.cumsum([states * vocabulary.classes, states * states]))
        emitted = emitted.reshape(states, -1).T + PRIOR * share[:, None]
        moved = moved.reshape(states, states) + 1 / states
        started = started + 1 / states
        model = Model(started / started.sum(), moved / moved.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))
        sent.unpersist()
    return model


def likelihood(model: Model, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log10 likelihood of whole sequences by the scaled forward recursion."""
    result, states = np.zeros(len(begin)), len(model.start)
    for pick in batches_of(size):
        b, n = begin[pick], size[pick]
        total, entry = np.zeros(len(b)), model.start
        span = max(1, 4 * CHUNK // len(b))  # steps at a time
        for t in range(0, int(n[0]), span):
            k = int(np.searchsorted(-n, -t, "left"))
            left = np.minimum(n[:k] - t, span)
            seen, place = packed(codes, b[:k] + t, left)
            alpha = np.empty((len(seen), states))
            forward(model, entry, place, np.take(model.emit, seen, axis=0), alpha, total)
            a = alpha[np.array(place)[left - 1] + np.arange(k)]
            ended = n[:k] <= t + span
            total[:k][ended] += np.log10(a[ended].sum(axis=1))
            entry = a[~ended] @ model.move
        result[pick] = total
    return result


def score(coded: DataFrame, counts: DataFrame, words: Vocabulary, model: Model) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text."""
    rare = word_rows(coded, without=words).select("block", "place", "word")
    known = rare.join(counts.select("word", "c"), "word").select("block", "place", "c")
    sent = send(coded.sparkSession, (words, model))

    def task(found: pa.Table, block: pa.Table) -> pa.Table:
        words, model = received(sent)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        parts = []
        for i in range(block.num_rows):
            hashes, shared = (np.asarray(block[c][i].values) for c in ("words", "shared"))
            kind = words.class_of(hashes.view(np.uint64), shared)
            c = np.zeros(len(hashes), np.int64)
            c[np.asarray(found["place"])] = np.asarray(found["c"])
            own = kind < len(words.own)
            c[own] = words.own_count[kind[own]]
            base = np.log10((c + 0.5) / (words.tokens + 0.5 * (words.kinds + 1)))
            inner = np.where(own, 0.0, np.log10((c + 0.5) / words.mass[np.maximum(kind - len(words.own), 0)]))
            tokens = np.frombuffer(block["tokens"][i].as_buffer(), np.int32)
            size = np.asarray(block["sizes"][i].values)
            begin = np.cumsum(size) - size
            exact = likelihood(model, kind[tokens], begin, size) + np.add.reduceat(inner[tokens], begin)
            parts.append(
                pa.table(
                    [
                        block["doc_ids"][i].values,
                        block["held"][i].values,
                        pa.array(size),
                        pa.array(np.add.reduceat((c > 0).astype(np.int64)[tokens], begin)),
                        pa.array(np.full(len(size), words.tokens, np.int64)),
                        pa.array(np.add.reduceat(base[tokens], begin)),
                        pa.array(exact),
                    ],
                    names,
                )
            )
        return pa.concat_tables(parts)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return known.groupBy("block").cogroup(coded.drop("train").groupBy("block")).applyInArrow(task, schema)


def score_texts(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """Trains on the rows of ``docs (doc_id, text, held_out)`` not held out, scores all."""
    from echorank.session import scratch_path

    path = scratch_path(docs.sparkSession, "llm-hmm-blocks")
    blocks(docs).write.option("maxRecordsPerFile", BLOCKS_PER_FILE).option("compression", "zstd").parquet(path)
    coded = docs.sparkSession.read.parquet(path)
    counts = count_words(coded)
    words = vocabulary(counts)
    return score(coded, counts, words, train(coded, words, states, iterations))
