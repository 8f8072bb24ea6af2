"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

The expressions are byte n-grams inside words, up to ``ORDER`` bytes with blanks at
the word's bounds, packed into one number each. From order ``SHARED`` + 1 on each
class has counts of its own (occurrences for the longest n-grams, distinct left
neighbours for shorter ones); at and below ``SHARED`` both classes back off to the
same counts of all labelled texts, so a rare expression cannot speak for a class by
its rarity. A word's evidence is the log-likelihood ratio of the two models. A text
is judged by two length-normalised figures: the mean over all its words and the mean
over the fiftieth part of its words that is most toxic (one word at least), mapped to
0..1 by a logistic function fitted on labelled texts that the models have not seen.

The classifier is fitted on a bounded sample of labelled texts: ``SAMPLE`` of them at
most, the first in the order of a hash of the id, and of these the ones of at most
``SAMPLE_BYTES`` bytes; a quarter is for the logistic function. n-grams are counted
by Spark; the count table, bounded by the sample, is collected and sent to the tasks.
Scoring covers every whole text.

Defined results: a text without words (NULL, empty) gets the share of toxic texts in
the sample; labels that are NULL are void, of several labels of an id the largest
counts; without toxic or without ordinary labels every text gets that share. Repeated
rows each give a row. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echorank.llm.lookup import Places, gather
from echorank.llm.tables import free_name, received, send, written
from echorank.llm.words import ALNUM, Hasher, Words, cut, slices

ORDER, SHARED = 6, 2
SAMPLE, SAMPLE_BYTES = 12_000, 1 << 16
#: The part of a text's words that is looked at as its most toxic one.
PART = 50
#: One more than a byte's values: the chance of any byte below all counts.
FLOOR = 1 / 257


def packed(words: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the picked words, and how many each word has (its bytes and one)."""
    size = words.ends[pick] - words.starts[pick]
    body = gather(words.data, words.starts[pick], size)
    full = size + ORDER
    line = np.full(int(full.sum()), 0x20, np.uint8)
    begin = np.cumsum(full) - full
    line[gather(np.arange(len(line)), begin + ORDER - 1, size)] = body
    at = gather(np.arange(len(line)), begin, size + 1)
    keys = np.zeros(len(at), np.uint64)
    for j in range(ORDER):
        keys = (keys << np.uint64(8)) | line[at + j]
    return keys, size + 1


def low(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes of packed n-grams."""
    return keys & np.uint64((1 << (8 * order)) - 1)


@dataclass
class Level:
    """One order of both models: discounted shares by n-gram, backoff weights by context."""

    grams: Places
    share: np.ndarray  # 2 x grams
    contexts: Places
    weight: np.ndarray  # 2 x contexts


def level(grams: np.ndarray, counts: np.ndarray) -> Level:
    """``counts``: one row a class over distinct n-grams."""
    heads = grams >> np.uint64(8)
    contexts, of = np.unique(heads, return_inverse=True)
    share, weight = np.zeros(counts.shape), np.ones((len(counts), len(contexts)))
    for c, n in enumerate(counts):
        once, twice = int((n == 1).sum()), int((n == 2).sum())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total = np.bincount(of, n, len(contexts))
        kinds = np.bincount(of, n > 0, len(contexts))
        share[c] = np.maximum(n - discount, 0) / np.maximum(total[of], 1)
        weight[c] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    return Level(Places(grams), share, Places(contexts), weight)


class Models:
    """Both Kneser-Ney models, from the counts of the longest n-grams by class."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels: list[Level] = []
        keys, own = grams, counts
        for order in range(ORDER, 0, -1):
            self.levels.append(level(keys, own))
            seen = own > 0
            if order - 1 <= SHARED:  # both classes back off to what either has
                seen = np.repeat(seen.any(axis=0)[None], 2, axis=0)
            keys, of = np.unique(low(keys, order - 1), return_inverse=True)
            own = np.stack([np.bincount(of, s, len(keys)) for s in seen])
        self.levels.reverse()
        self.known = self.levels[-1].grams
        self.ratio = self.score(grams)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio, toxic against ordinary, of the last byte of each n-gram."""
        p = np.full((2, len(keys)), FLOOR)
        for order, x in enumerate(self.levels, 1):
            g = low(keys, order)
            place, context = x.grams(g), x.contexts(g >> np.uint64(8))
            p *= np.where(context >= 0, x.weight[:, context], 1.0)
            p += np.where(place >= 0, x.share[:, place], 0.0)
        return np.log(p[1]) - np.log(p[0])

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        place = self.known(keys)
        out = self.ratio[place]
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh, of = np.unique(keys[new], return_inverse=True)
            out[new] = self.score(fresh)[of]
        return out

    def figures(self, words: Words) -> np.ndarray:
        """Per text the mean ratio of its words and that of its most toxic part; NaN without words."""
        _, pick, of = np.unique(words.hashes, return_index=True, return_inverse=True)
        out = np.full((len(words.first) - 1, 2), np.nan)
        if not len(pick):
            return out
        keys, size = packed(words, pick)
        evidence = np.add.reduceat(self.ratios(keys), np.cumsum(size) - size)[of]
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            if b > a:
                e, k = evidence[a:b], max(1, (b - a) // PART)
                out[i] = e.mean(), np.partition(e, len(e) - k)[len(e) - k :].mean()
        return out


@dataclass
class Classifier:
    prior: float
    models: Models | None
    mean: np.ndarray
    scale: np.ndarray
    slope: np.ndarray
    shift: float

    def __call__(self, figures: np.ndarray) -> np.ndarray:
        if self.models is None:
            return np.full(len(figures), self.prior)
        z = ((figures - self.mean) / self.scale) @ self.slope + self.shift
        return np.where(np.isnan(z), self.prior, 1 / (1 + np.exp(-np.clip(z, -500, 500))))


def logistic(x: np.ndarray, y: np.ndarray, prior: float, models: Models) -> Classifier:
    """A ridge logistic fit by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(a.shape[1]), np.diag([0.1] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return Classifier(prior, models, mean, scale, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Classifier:
    """``docs (doc_id, text)`` and ``labels (doc_id, toxic)`` that may be learned from."""
    some = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = written(
        docs.select("doc_id", "text")
        .join(F.broadcast(some), "doc_id")
        .where(F.octet_length("text") <= sample_bytes)
        .select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).alias("judge")),
        "toxicity-sample",
    )
    tally = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    total = sum(tally.values())
    prior = tally.get(1, 0) / total if total else 0.0
    none = Classifier(prior, None, np.zeros(2), np.ones(2), np.zeros(2), 0.0)
    if len(tally) < 2:
        return none

    def count(batches):
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch):
                words, toxic = cut(part.column("text"), ALNUM, hasher), np.asarray(part.column("toxic"))
                owner = np.repeat(toxic, np.diff(words.first))
                for c in (0, 1):
                    keys, n = np.unique(packed(words, np.flatnonzero(owner == c))[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), c, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))],
                        ["toxic", "gram", "n"],
                    )

    counted = rows.where(~F.col("judge")).select("text", "toxic").mapInArrow(count, "toxic int, gram long, n long")
    by_class = counted.groupBy("gram").agg(*[F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)])
    found = by_class.toArrow()
    counts = np.stack([np.asarray(found["n0"]), np.asarray(found["n1"])]).astype(float)
    if not counts.any(axis=1).all():
        return none
    models = Models(np.asarray(found["gram"]).astype(np.uint64), counts)
    raw = Classifier(prior, models, np.zeros(2), np.ones(2), np.zeros(2), 0.0)
    for judge in (True, False):  # without both classes among the held back texts, all are used
        seen = figures(rows.where(F.col("judge")) if judge else rows, raw, ["toxic"]).where(~F.isnan("f1")).toArrow()
        y = np.asarray(seen["toxic"]).astype(float)
        if 0 < y.sum() < len(y):
            return logistic(np.column_stack([np.asarray(seen["f1"]), np.asarray(seen["f2"])]), y, prior, models)
    return none


def figures(docs: DataFrame, classifier: Classifier, keep: list[str]) -> DataFrame:
    """``keep``, ``f1`` and ``f2``: the two figures of each text."""
    sent = send(docs.sparkSession, classifier)
    kept = docs.select(*keep).schema.fields

    def task(batches):
        hasher, models = Hasher(), received(sent).models
        for batch in batches:
            for part in slices(batch, len(kept)):
                f = models.figures(cut(part.column(len(kept)), ALNUM, hasher))
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(f[:, 0]), pa.array(f[:, 1])], [*[k.name for k in kept], "f1", "f2"])

    schema = T.StructType([*kept, T.StructField("f1", T.DoubleType()), T.StructField("f2", T.DoubleType())])
    return docs.select(*keep, F.col("text").alias(free_name(keep, "text"))).mapInArrow(task, schema)


def with_score(docs: DataFrame, classifier: Classifier, name: str) -> DataFrame:
    """``docs`` and one more column ``name``: the toxicity of ``text``, 0 to 1."""
    sent = send(docs.sparkSession, classifier)
    place = docs.columns.index("text")

    def task(batches):
        hasher, judge = Hasher(), received(sent)
        for batch in batches:
            for part in slices(batch, place):
                if judge.models is None:
                    score = np.full(part.num_rows, judge.prior)
                else:
                    score = judge(judge.models.figures(cut(part.column(place), ALNUM, hasher)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, name])

    return docs.mapInArrow(task, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, classifier: Classifier, threshold: float) -> DataFrame:
    """``docs`` without the texts that reach the threshold, all columns kept."""
    name = free_name(docs.columns, "score")
    return with_score(docs, classifier, name).where(F.col(name) < threshold).select(*docs.columns)


def fold(doc_id: Column, parts: int) -> Column:
    """The CRC-32 of the id as text, modulo ``parts``; a NULL id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))
