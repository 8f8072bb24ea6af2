"""A semi-Markov conditional random field over short stretches of text.

A stretch is cut into tokens (letters, digits, single other characters). A labelling
cuts it into segments: one token of no kind, or the tokens of one entity of a kind.
Segments are scored as a whole by features of the span and its surroundings, and
neighbouring segments by their kinds. Only spans that are well formed for a kind are
candidates; they are found by their form (a name and its domain, digits and marks), so
no number of tokens bounds an address, and a number ends with its 19th digit. Weights
maximise the likelihood of given labellings (forward-backward over segments, Adagrad);
decoding is the Viterbi path, which keeps only the states that a segment can still reach.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Digits of the longest number.
DIGITS_MOST = 19

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[{] ?at ?[)\]}]) ?[A-Za-z0-9-]+(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[A-Za-z0-9-]+)+", re.I)
#: An address by its parts: a name with the first label of its domain, and each label after that.
HEAD = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[{] ?at ?[)\]}]) ?[A-Za-z0-9-]+", re.I)
LABEL = re.compile(r"(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[A-Za-z0-9-]+", re.I)
NUMBER = re.compile(r"\+?[(0-9][0-9 ().+-]*[0-9]")
GROUP = re.compile("([ ().+-]*)([0-9]+)")
DIGITS = re.compile("[0-9]+")
WORD = re.compile(r"([A-Za-z]+)[\s:.#-]{0,3}$")
LONGER = re.compile(r"[\w-]|\.\w| ?[(\[{] ?dot ?[)\]}] ?\w", re.I)  # a domain goes on
CUES = frozenset("tel phone mobile cell call fax mail email contact ip host server address card visa credit number".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def byte_number(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def well_formed(kind: str, span: str) -> bool:
    """Whether a span can be of a kind at all."""
    if kind == "email":
        return ADDRESS.fullmatch(span) is not None
    if not NUMBER.fullmatch(span):
        return False
    groups = DIGITS.findall(span)
    n = sum(map(len, groups))
    if kind == "ip":
        return len(groups) == 4 and all(map(byte_number, groups)) and set(span) <= set("0123456789.") and span.count(".") == 3
    if kind == "card":
        return 14 <= n <= 19 and set(span) <= set("0123456789 -.") and luhn("".join(groups))
    return 10 <= n <= 15 and len(groups) > 1 and "." * 3 not in span


def bounded(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a span is not a part of a longer name or number."""
    before, after = text[start - 1 : start], text[end : end + 1]
    if kind == "email":
        return not before.isalnum() and before not in set("._%+-") and not LONGER.match(text, end)
    return not before.isalnum() and not after.isalnum()


def features(kind: str, text: str, start: int, end: int) -> list[str]:
    """Whole-span features of a candidate."""
    span = text[start:end]
    groups = DIGITS.findall(span)
    before, after = text[start - 1 : start], text[end : end + 1]
    cue = WORD.search(text[max(0, start - 24) : start])
    found = ["bias", f"before={before}", f"after={after}"]
    if cue and cue[1].lower() in CUES:
        found.append("cue=" + cue[1].lower())
    if kind == "email":
        tail = re.search("[A-Za-z]*$", span)[0]
        found += ["plain" if "@" in span else "written", "tail" if 2 <= len(tail) <= 6 else "no tail"]
    else:
        found.append(f"digits={min(20, sum(map(len, groups)))}")
        found.append("groups=" + "-".join(str(len(g)) for g in groups[:7]))
        found.append("marks=" + "".join(sorted(set(span) - set("0123456789"))))
        if luhn("".join(groups)):
            found.append("luhn")
    return [f"{kind}|{f}" for f in found]


def candidates(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """All segments of a kind that begin with the token at ``start``: (end, kind)."""
    first, before = text[start], text[start - 1 : start]
    if before.isalnum():
        return
    if first.isalnum() or first == "+":
        found = before not in set("._%+-") and HEAD.match(text, start, stop)
        while found and (found := LABEL.match(text, found.end(), stop)):
            end = found.end()
            if text[end - 1].isalnum() and bounded("email", text, start, end):
                yield end, 1
    if first in "0123456789(+":
        end, tokens, digits = start, 0, 0
        while (found := GROUP.match(text, end, stop)) and digits + len(found[2]) <= DIGITS_MOST:
            end, tokens, digits = found.end(), tokens + len(found[1]) + 1, digits + len(found[2])
            if tokens > 2 and not text[end : end + 1].isalnum():
                for k, kind in enumerate(KINDS[1:], 2):
                    if well_formed(kind, text[start:end]):
                        yield end, k


@dataclass
class Segments:
    """Token bounds of a stretch and its candidates by their last token: (first, kind, features)."""

    tokens: list[tuple[int, int]]
    ending: list[list[tuple[int, int, list[str]]]]

    @classmethod
    def of(cls, text: str) -> Segments:
        tokens = [m.span() for m in TOKEN.finditer(text)]
        ending: list[list[tuple[int, int, list[str]]]] = [[] for _ in range(len(tokens) + 1)]
        last = {b: j for j, (_, b) in enumerate(tokens, 1)}
        for i, (start, _) in enumerate(tokens):
            for end, k in candidates(text, start, len(text)):
                ending[last[end]].append((i, k, features(KINDS[k - 1], text, start, end)))
        return cls(tokens, ending)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis)) + top


@dataclass
class SemiCrf:
    weights: dict[str, float] = field(default_factory=dict)
    following: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS) + 1, len(KINDS) + 1)))

    def score(self, names: list[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)

    def decode(self, text: str, start: int = 0, stop: int | None = None) -> list[tuple[str, int, int]]:
        """The best segments of a kind between two places of a text, as (kind, start, end).

        A state is the best score of a labelling up to a place and its segments so far, as
        a chain that labellings share; states behind the place are given up.
        """
        stop = len(text) if stop is None else stop
        follow, none = self.following.tolist(), [(float("-inf"), None)] * (len(KINDS) + 1)
        states, here = {start: [(0.0, None), *none[1:]]}, start
        for token in TOKEN.finditer(text, start, stop):
            at, here = token.span()
            come = states.pop(at)
            steps = [(here, 0, 0.0), *((end, k, self.score(features(KINDS[k - 1], text, at, end))) for end, k in candidates(text, at, stop))]
            for end, k, score in steps:
                top, p = max((come[p][0] + follow[p][k], -p) for p in range(len(come)))
                to = states.setdefault(end, none.copy())
                if top + score > to[k][0]:
                    chain = come[-p][1]
                    to[k] = top + score, ((KINDS[k - 1], at, end), chain) if k else chain
        out, chain = [], max(states[here], key=lambda s: s[0])[1]
        while chain:
            span, chain = chain
            out.append(span)
        return out[::-1]

    def gradient(self, s: Segments, gold: set[tuple[int, int, int]]) -> tuple[dict[str, float], np.ndarray]:
        """Observed less expected features, ``gold``: (first, last, kind) of token segments."""
        n, kinds = len(s.tokens), len(KINDS) + 1
        steps = [[]] + [[(j - 1, 0, 0.0, []), *((i, k, self.score(f), f) for i, k, f in s.ending[j])] for j in range(1, n + 1)]
        alpha, beta = np.full((n + 1, kinds), -np.inf), np.full((n + 1, kinds), -np.inf)
        alpha[0, 0] = 0.0
        for j in range(1, n + 1):
            for i, k, score, _ in steps[j]:
                alpha[j, k] = np.logaddexp(alpha[j, k], log_sum(alpha[i] + self.following[:, k], 0) + score)
        beta[n] = 0.0
        for j in range(n, 0, -1):
            for i, k, score, _ in steps[j]:
                beta[i] = np.logaddexp(beta[i], self.following[:, k] + score + beta[j, k])
        total = log_sum(alpha[n], 0)
        names, follow = defaultdict(float), np.zeros((kinds, kinds))
        last, spot = 0, 0
        truth: set[tuple[int, int, int]] = set()
        while spot < n:  # the given labelling as a path
            ends = [(j, k) for i, j, k in gold if i == spot]
            j, k = ends[0] if ends else (spot + 1, 0)
            truth.add((spot, j, k))
            follow[last, k] += 1
            last, spot = k, j
        for j in range(1, n + 1):
            for i, k, score, f in steps[j]:
                p = np.exp(alpha[i] + self.following[:, k] + score + beta[j, k] - total)
                follow[:, k] -= p
                for name in f:
                    names[name] += ((i, j, k) in truth) - p.sum()
        return names, follow

    def train(self, examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 5, rate: float = 0.4, ridge: float = 1e-3) -> SemiCrf:
        """``examples``: a stretch and the spans in it; spans that are no candidates are left out."""
        ready = []
        for text, spans in examples:
            s = Segments.of(text)
            first, last = {a: i for i, (a, _) in enumerate(s.tokens)}, {b: i + 1 for i, (_, b) in enumerate(s.tokens)}
            offered = {(i, j, k) for j, row in enumerate(s.ending) for i, k, _ in row}
            gold = {(first.get(a, -1), last.get(b, -1), KINDS.index(kind) + 1) for kind, a, b in spans} & offered
            if offered:
                ready.append((s, gold))
        square, square_f = defaultdict(float), np.zeros_like(self.following)
        for _ in range(epochs):
            for s, gold in ready:
                names, follow = self.gradient(s, gold)
                for name, g in names.items():
                    g -= ridge * self.weights.get(name, 0.0)
                    square[name] += g * g
                    self.weights[name] = self.weights.get(name, 0.0) + rate * g / (1e-3 + square[name] ** 0.5)
                follow[0, 0] = 0.0  # no weight for a token of no kind, so long segments are not at a loss
                square_f += follow**2
                self.following += rate * follow / (1e-3 + np.sqrt(square_f)) * (square_f > 0)
        return self
