"""Personal data: plain patterns, and spans that a semi-Markov CRF adds to them.

The base patterns are found exactly (see ``base_spans``). The CRF reads the stretches
around digits and at-signs that no base span covers, and adds what it takes for an
e-mail address, an IP address, a card or a phone number written in another way; a
span that meets a base span is not added. A stretch reaches to the end of the name, the
domain or the number it is about, whatever their length.

The CRF is trained on the base spans themselves, in a bounded sample of texts:
``SAMPLE`` of them at most, the first in the order of a hash, of at most
``SAMPLE_BYTES`` bytes, and at most ``EXAMPLES`` stretches. Each span is also shown in
other spellings, and damaged ones (a wrong check digit, a number out of range) as no
span, so that the weights rest on the form and not on the one mark a pattern needs.

Defined results: NULL is an empty text without spans; repeated rows each give a row;
with nothing to train on no span is added. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echorank.llm.semicrf import KINDS, LABEL, SemiCrf, byte_number, luhn
from echorank.llm.tables import free_name, received, send
from echorank.llm.words import slices

SAMPLE, SAMPLE_BYTES, EXAMPLES = 2_000, 1 << 16, 600
#: Code points of context on either side of a stretch, and of a stretch to train on.
CONTEXT, STRETCH = 24, 2000

Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMERIC = re.compile(r"[0-9+][0-9 ().+-]{6,}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WRITTEN_AT = re.compile(r"[(\[{] ?at ?[)\]}]", re.I)
OTHER = re.compile("[^0-9]+")
FIRST_LABEL = re.compile(" ?[A-Za-z0-9-]*")
MARKS = frozenset(" ().+-")


def emails(text: str) -> list[Span]:
    """Leftmost matches: the longest name before an at-sign, then the longest domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            out.append(("email", start, free))
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def numbers(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """IP, card and phone matches, and the stretches of digits and marks they lie in."""
    out, runs = [], []
    for m in NUMERIC.finditer(text):
        start, run = m.start(), m.group()
        digits = len(OTHER.sub("", run))
        if digits >= 10:
            runs.append(m.span())
        if run.count(".") >= 3:
            for x in IP.finditer(run):
                if all(map(byte_number, x.group().split("."))):
                    out.append(("ip", start + x.start(), start + x.end()))
        if digits >= 14:
            for x in CARD.finditer(run):
                d = OTHER.sub("", x.group())
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append(("card", start + x.start(), start + x.end()))
        if "+" in run and digits >= 10:
            for x in PHONE.finditer(run):
                if 10 <= len(OTHER.sub("", x.group())) <= 15:
                    out.append(("phone", start + x.start(), start + x.end()))
    return out, runs


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """All base matches in order, and the places that the CRF has to look at.

    A match never leaves its run of digits and marks, so each pattern is tried inside
    the runs only; a part of a number cannot match where the whole one does not.
    """
    found = emails(text)
    number, runs = numbers(text)
    runs += [(m.start(), m.end()) for m in WRITTEN_AT.finditer(text)] if "at" in text.lower() and ("(" in text or "[" in text or "{" in text) else []
    inside, at = iter(found), text.find("@")
    span = next(inside, None)
    while at >= 0:
        while span and span[2] <= at:
            span = next(inside, None)
        if not (span and span[1] <= at):
            runs.append((at, at + 1))
        at = text.find("@", at + 1)
    return ordered(found + number), runs


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Cover:
    """Which places the spans take; they may overlap."""

    def __init__(self, spans: list[Span]):
        self.starts = [a for _, a, _ in spans]
        self.ends = list(accumulate((b for _, _, b in spans), max))  # the furthest end so far

    def reach(self, at: int) -> int:
        """The furthest end of the spans that begin at ``at`` or before."""
        i = bisect_right(self.starts, at)
        return self.ends[i - 1] if i else -1

    def meets(self, start: int, stop: int) -> bool:
        return self.reach(stop - 1) > start


def whole(text: str, a: int, b: int) -> tuple[int, int]:
    """A run with the name before and the domain after it, or with the marks before a number."""
    if text[b - 1] in "@)]}" and text[a] in "@([{":
        a -= text[a - 1 : a] == " "
        while a and text[a - 1] in LOCAL:
            a -= 1
        b = FIRST_LABEL.match(text, b).end()
        while found := LABEL.match(text, b):
            b = found.end()
    else:
        while a and text[a - 1] in MARKS:
            a -= 1
    return a, b


def stretches(text: str, runs: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int]]:
    """Bounds around the runs that base spans do not cover and what belongs to them, merged."""
    cover, around, out = Cover(spans), [], []
    for a, b in runs:
        end = cover.reach(a)
        if end >= b or end > a and len(OTHER.sub("", text[end:b])) < 7:
            continue
        first, last = whole(text, a, b)
        left = max(text.rfind("\n", max(0, a - 2 * CONTEXT), a) + 1, a - 2 * CONTEXT, 0)
        right = text.find("\n", b, b + 2 * CONTEXT)
        right = min(len(text), b + 2 * CONTEXT) if right < 0 else right
        around.append((min(left, first), max(right, last)))
    for left, right in sorted(around):
        if out and left <= out[-1][1]:
            out[-1][1] = max(out[-1][1], right)
        else:
            out.append([left, right])
    return [(a, b) for a, b in out]


def all_spans(text: str | None, crf: SemiCrf) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans together."""
    if not text:
        return [], []
    base, runs = base_spans(text)
    added: list[Span] = []
    if runs and crf.weights:
        cover = Cover(base)
        for a, b in stretches(text, runs, base):
            added += [(kind, s, e) for kind, s, e in crf.decode(text, a, b) if not cover.meets(s, e)]
    return base, ordered(base + added)


def spellings(kind: str, span: str, rng: random.Random) -> list[tuple[str, bool]]:
    """A span written otherwise (True) or damaged (False)."""
    digits = OTHER.sub("", span)
    if kind == "email":
        name, _, domain = span.partition("@")
        return [(f"{name} (at) {domain}", True), (f"{name} [at] {domain.replace('.', ' [dot] ')}", True), (f"{name} @ {domain}", True), (f"{name} at", False)]
    if kind == "ip":
        parts = span.split(".")
        return [(".".join(["9" + parts[0].zfill(3), *parts[1:]]), False), (".".join([*parts, "7", "1"]), False)]
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randrange(1, 10)) % 10)
        return [(".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), True), (wrong, False)]
    ten, lead = digits[-10:], digits[:-10]
    grouped = f"{ten[:3]}-{ten[3:6]}-{ten[6:]}"
    return [
        (f"({ten[:3]}) {ten[3:6]}-{ten[6:]}", True), (grouped, True), (f"{ten[:3]}.{ten[3:6]}.{ten[6:]}", True), (f"{lead or '1'}-{grouped}", True),
        (digits, False), (f"{ten[:4]}-{ten[4:6]}-{ten[6:8]} {ten[8:]}:00", False), (f"{ten[:5]} {ten[5:]} {lead}", False),
    ]


def examples(text: str) -> list[tuple[str, list[Span]]]:
    """Training stretches of a text: as they are, with other spellings, and damaged."""
    base, runs = base_spans(text)
    rng, out, before = random.Random(len(text)), [], Cover(base)
    for n, (kind, a, b) in enumerate(base):
        if n and before.ends[n - 1] > a or n + 1 < len(base) and base[n + 1][1] < b:  # it meets another one
            continue
        left, right = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
        for span, good in [(text[a:b], True), *spellings(kind, text[a:b], rng)]:
            out.append((left + span + right, [(kind, len(left), len(left) + len(span))] if good else []))
    around = [(s, min(b, s + STRETCH)) for a, b in stretches(text, runs, base) for s in range(a, b, STRETCH - 4 * CONTEXT)]
    out += [(text[a:b], []) for a, b in around if not before.meets(a, b)]
    return out


def train(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, most: int = EXAMPLES) -> SemiCrf:
    """A CRF trained on the base spans of a bounded sample of ``docs (text)``."""
    fit = (F.octet_length("text") <= sample_bytes) & F.col("text").rlike("[0-9]{3}|@")
    hashed = docs.select("text").where(fit).withColumn("h", F.xxhash64("text"))
    # The bound is found on hashes alone, so no task gathers the texts of the others.
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = hashed.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min("text").alias("text")).select("text")

    def task(batches):
        for batch in batches:
            rows = [e for t in batch.column(0).to_pylist() for e in examples(t)]
            keys = ["|".join([t, *(f"{k}:{a}:{b}" for k, a, b in s)]) for t, s in rows]
            spans = [[{"kind": k, "start": a, "stop": b} for k, a, b in s] for _, s in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in rows], pa.string()), pa.array(spans, SPANS), pa.array(keys, pa.string())], ["text", "spans", "key"]
            )

    found = some.mapInArrow(task, "text string, spans array<struct<kind:string,start:int,stop:int>>, key string")
    rows = found.orderBy(F.xxhash64("key"), "key").limit(most).collect()
    return SemiCrf().train([(r["text"], [(s["kind"], s["start"], s["stop"]) for s in r["spans"]]) for r in rows])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def mapped_spans(docs: DataFrame, crf: SemiCrf, keep: list[str], fields: list[T.StructField], types: list[pa.DataType], derive: Callable) -> DataFrame:
    """``keep`` and what ``derive(text, base, spans)`` gives of each text."""
    sent = send(docs.sparkSession, crf)
    kept = docs.select(*keep).schema.fields

    def task(batches):
        model = received(sent)
        for batch in batches:
            for part in slices(batch, len(kept)):
                rows = [derive(t, *all_spans(t, model)) for t in part.column(len(kept)).to_pylist()]
                made = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), types)]
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *made], [f.name for f in [*kept, *fields]])

    schema = T.StructType([*kept, *fields])
    return docs.select(*keep, F.col("text").alias(free_name(keep, "text"))).mapInArrow(task, schema)


def find_spans(docs: DataFrame, crf: SemiCrf, keep: list[str], base: str = "base", spans: str = "spans") -> DataFrame:
    """``keep`` and two columns: the base spans and all spans of each text."""
    as_rows = lambda s: [{"kind": k, "start": a, "stop": b} for k, a, b in s]
    kind = T.ArrayType(T.StructType.fromDDL("kind string, start int, stop int"))
    fields = [T.StructField(base, kind), T.StructField(spans, kind)]
    return mapped_spans(docs, crf, keep, fields, [SPANS, SPANS], lambda t, b, s: (as_rows(b), as_rows(s)))


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind; spans that meet are one."""
    if not spans:
        return text
    out, free, i = [], 0, 0
    while i < len(spans):
        kind, a, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[free:a], f"<{kind.upper()}>"]
        free, i = b, i + 1
    return "".join([*out, text[free:]])


def redact(docs: DataFrame, crf: SemiCrf) -> DataFrame:
    """``docs`` with the spans in ``text`` masked, all columns kept in order."""
    keep, name = [c for c in docs.columns if c != "text"], free_name(docs.columns, "masked")
    done = mapped_spans(docs, crf, keep, [T.StructField(name, T.StringType())], [pa.string()], lambda t, b, s: (masked(t, s),))
    return done.select(*[F.col(name).alias("text") if c == "text" else F.col(c) for c in docs.columns])
