"""Repair of conversation structure with Four-Russians block tables.

Wanted are the roles ``(system? (user assistant)+)?``. Faults are found per row: blank,
said before, cut off. The cheapest edits (keep, rerole, delete, insert) are a shortest path
over four states: nothing yet, after the system turn, after a user, after an assistant. A
column of path costs, less its least one, is one of a few vectors, since states can be
reached from each other at bounded cost. For every such vector and every block of
``BLOCK`` symbols the next vector and the cost added are computed once per task, so a
conversation is read a block at a time by lookup. For the edits themselves blocks are
expanded again from the last to the first: which states lie on a cheapest path. From the
front the least letter is then taken that stays on one, so that ties are exact.

At scale: rows are range-sorted once, with text, and get their place in the order. All that
follows moves a few bytes a row: repeats are found by the least place per role and text
digest, a row is one symbol letter, letters are joined in pieces of ``PIECE`` places and the
pieces by conversation. So a task holds a conversation as one byte a row, which is what its
audit string needs in any case, and never its texts. Edits meet the texts in a second
shuffle by conversation; ``repaired`` streams the result in order. Only a digest over a whole
conversation keeps one task busy for as long as the conversation is.

Defined results: NULL roles and texts count as one space, NULL turns stand first and have no
part in gaps. Rows of one turn stand by role, then by the first 32 characters of the text,
then by its MD5; rows that agree in all are interchangeable. Any letter but s, u, a at the
start of a role (none, too) fits nowhere. A NULL conversation is one like others. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echorank.llm.tables import written
from echorank.llm.words import slices

#: Symbols looked up together; places in the order of rows that form a piece.
BLOCK, PIECE = 4, 1 << 12
KEEP, CHANGE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: More than any state of a cheapest path can cost above the least one: 6 + DELETE < 12.
CAP = 12

START, SYSTEM, USER, ASSISTANT = range(4)
#: Initials and faults of a symbol letter: chr(65 + 4 * initial + fault).
OTHER_INITIAL, S, U, A = range(4)
FINE, BLANK, REPEATED, CUT_OFF = range(4)
#: Classes of symbols: 0 no row, 1 + 2 * initial + cut off, and one for rows that must go.
PAD, GONE, CLASSES = 0, 9, 10
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_NAMES = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}


def actions(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """What may be done with a row: letter, next state, cost, in the order of letters."""
    out = [("D", state, DELETE)]
    if symbol != GONE:
        initial, cut = (symbol - 1) >> 1, CUT * ((symbol - 1) & 1)
        if (state, initial) == (START, S):
            out.append(("K", SYSTEM, KEEP + cut))
        elif (_NEXT[state], initial) in ((USER, U), (ASSISTANT, A)):
            out.append(("K", _NEXT[state], KEEP + cut))
        out.append(("R", _NEXT[state], CHANGE + cut))
    return out


class Blocks:
    """Normalised cost vectors and their transitions, by symbol and by block."""

    def __init__(self, block: int = BLOCK):
        first = self._normal([0, CAP, CAP, CAP])[0]
        self.vectors, self.block = [first], block
        places, step, add = {first: 0}, [], []
        for vector in self.vectors:  # grows on the way
            step.append([len(step)])
            add.append([0])
            for symbol in range(1, CLASSES):
                cost = [4 * CAP] * 4
                for state in range(4):
                    for _, to, c in actions(state, symbol):
                        cost[to] = min(cost[to], vector[state] + c)
                new, least = self._normal(cost)
                if new not in places:
                    places[new] = len(self.vectors)
                    self.vectors.append(new)
                step[-1].append(places[new])
                add[-1].append(least)
        self.step, self.add = step, add
        digits = np.arange(CLASSES**block)
        at, cost = np.repeat(np.arange(len(step))[:, None], len(digits), 1), 0
        for j in range(block):
            symbol = digits // CLASSES ** (block - 1 - j) % CLASSES
            cost, at = cost + np.array(add)[at, symbol], np.array(step)[at, symbol]
        self.block_step, self.block_add = at.tolist(), cost.tolist()
        self.powers = CLASSES ** np.arange(block - 1, -1, -1)
        self.viable, self.write = lru_cache(1 << 16)(self._viable), lru_cache(1 << 17)(self._write)

    @staticmethod
    def _normal(cost: list[int]) -> tuple[tuple[int, ...], int]:
        """A vector with inserts allowed, less its least entry."""
        cost = list(cost)
        cost[USER] = min(cost[USER], min(cost[START], cost[SYSTEM], cost[ASSISTANT]) + INSERT)
        cost[ASSISTANT] = min(cost[ASSISTANT], cost[USER] + INSERT)
        least = min(cost)
        return tuple(min(c - least, CAP) for c in cost), least

    def before_inserts(self, vector: int, mask: int) -> int:
        """With the states from which inserts lead to those of the mask at no more than the least cost."""
        cost = self.vectors[vector]
        for _ in range(2):
            for state in range(4):
                to = _NEXT[state]
                if mask >> to & 1 and cost[state] + INSERT == cost[to]:
                    mask |= 1 << state
        return mask

    def _symbols(self, code: int) -> list[int]:
        return [code // int(p) % CLASSES for p in self.powers]

    def _path(self, vector: int, code: int) -> list[int]:
        out = [vector]
        for symbol in self._symbols(code):
            out.append(self.step[out[-1]][symbol])
        return out

    def _edges(self, path: list[int], code: int, i: int, state: int, mask: int) -> list[tuple[str, int]]:
        """Actions with the block's row ``i`` that stay on a cheapest path."""
        symbol = self._symbols(code)[i]
        now, then, add = self.vectors[path[i]], self.vectors[path[i + 1]], self.add[path[i]][symbol]
        return [(a, to) for a, to, c in actions(state, symbol) if mask >> to & 1 and now[state] + c == then[to] + add]

    def _viable(self, vector: int, code: int, mask: int) -> tuple[int, ...]:
        """The states on a cheapest path at each place of a block, from those at its end."""
        path, masks = self._path(vector, code), [mask]
        for i in reversed(range(self.block)):
            if self._symbols(code)[i] != PAD:
                mask = sum(1 << q for q in range(4) if self._edges(path, code, i, q, mask))
                mask = self.before_inserts(path[i], mask)
            masks.append(mask)
        return tuple(reversed(masks))

    def _write(self, vector: int, code: int, mask: int, state: int) -> tuple[tuple[str, ...], int]:
        """The edits of a block's rows, the least letters first, and the state after them."""
        path, masks, out = self._path(vector, code), self.viable(vector, code, mask), []
        for i, symbol in enumerate(self._symbols(code)):
            if symbol == PAD:
                continue
            token = ""
            while True:
                edges, cost, to = self._edges(path, code, i, state, masks[i + 1]), self.vectors[path[i]], _NEXT[state]
                insert = masks[i] >> to & 1 and cost[state] + INSERT == cost[to]
                if insert and not (edges and edges[0][0] < "I"):
                    token, state = token + "ua"[to == ASSISTANT], to
                    continue
                letter, after = edges[0]
                out.append(token + ({USER: "U", ASSISTANT: "A"}[after] if letter == "R" else letter))
                state = after
                break
        return tuple(out), state

    def solve(self, symbols: bytes):
        """Cost of the cheapest edits and an iterator over the edits, one token a row."""
        classes = _CLASS[np.frombuffer(symbols, np.uint8)]
        padded = np.zeros(-(-len(classes) // self.block) * self.block, np.int64)
        padded[: len(classes)] = classes
        codes = array("l", (padded.reshape(-1, self.block) @ self.powers).tolist())
        at, cost = array("l", [0]), 0
        for code in codes:
            cost += self.block_add[at[-1]][code]
            at.append(self.block_step[at[-1]][code])
        end = self.vectors[at[-1]]
        least = min(end[START], end[ASSISTANT])
        final = sum(1 << q for q in (START, ASSISTANT) if end[q] == least)
        masks = bytearray([self.before_inserts(at[-1], final)])
        for i in reversed(range(len(codes))):
            masks.append(self.viable(at[i], codes[i], masks[-1])[0])
        masks.reverse()
        return cost + least, self._tokens(codes, at, masks, final)

    def _tokens(self, codes, at, masks, final):
        state, held = START, None
        for i, code in enumerate(codes):
            tokens, state = self.write(at[i], code, masks[i + 1], state)
            for token in tokens:
                if held is not None:
                    yield held
                held = token
        while held is not None and not final >> state & 1:
            state = _NEXT[state]
            held += "ua"[state == ASSISTANT]
        if held is not None:
            yield held


_LETTERS = np.arange(256) - 65
_CLASS = np.where(np.isin(_LETTERS & 3, (BLANK, REPEATED)), GONE, 1 + 2 * (_LETTERS >> 2) + ((_LETTERS & 3) == CUT_OFF))
_AUDIT = str.maketrans("uaUA", "IIRR")


def ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows in order, written once, with their place ``g`` (rising, with gaps)."""
    plain = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    keyed = plain.withColumn("_head", F.left("text", F.lit(32))).withColumn("_md5", F.md5("text")).withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_head", "_md5", "_tie"]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_head", "_tie").withColumn("g", F.monotonically_increasing_id())
    return written(placed.withColumnRenamed("_md5", "digest"), "dialogue-rows")


def symbols(rows: DataFrame) -> DataFrame:
    """The symbol letter of each ordered row: its initial and its first fault."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    closed = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.greatest(F.lit(0), F.instr(F.lit("sua"), F.left("role", F.lit(1))))
    initial = F.when(F.length("role") > 0, initial).otherwise(OTHER_INITIAL)
    slim = rows.select("g", "conv", "role", "digest", initial.alias("initial"), blank.alias("blank"), closed.alias("closed"))
    first = slim.where(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), REPEATED).when(~F.col("closed"), CUT_OFF).otherwise(FINE)
    return slim.join(first, "g", "left").select("conv", "g", F.char(F.lit(65) + 4 * F.col("initial") + fault).alias("symbol"))


def solved(letters: DataFrame) -> DataFrame:
    """Edits of all conversations.

    A row per piece: ``conv``, the place ``g`` of its first row, ``ops`` with a token per
    row; and a row per conversation with ``cost``, ``audit`` and counts of faults. A token
    is the action (D, K, U or A for a new role) between the letters of inserted roles.
    """
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("g", "symbol"))), lambda x: x["symbol"]))
    pieces = letters.groupBy("conv", F.shiftright("g", PIECE.bit_length() - 1).alias("piece")).agg(F.min("g").alias("g"), joined.alias("symbols"))
    convs = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("g", "symbols"))).alias("pieces"))
    conv_type = letters.schema["conv"]
    ops_schema = T.StructType([conv_type]).add("g", "long").add("ops", T.ArrayType(T.StringType()))
    for name in ("cost", "blank", "duplicate", "truncated", "illegal"):
        ops_schema = ops_schema.add(name, "long")
    ops_schema = ops_schema.add("audit", "string")
    names = [f.name for f in ops_schema]
    types = [pa.int64(), pa.list_(pa.string()), *[pa.int64()] * 5, pa.string()]

    def solve(batches):
        blocks = Blocks()
        for batch in batches:
            taken, rows, held = [], [], 0

            def flush():
                out = [batch.column(0).take(pa.array(taken, pa.int64()))]
                out += [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                return pa.RecordBatch.from_arrays(out, names)

            for i in range(batch.num_rows):
                parts = batch.column(1)[i].as_py()
                text = "".join(p["symbols"] for p in parts).encode()
                cost, tokens = blocks.solve(text)
                audit = []
                for p in parts:
                    ops = [next(tokens) for _ in range(len(p["symbols"]))]
                    audit.append("".join(ops).translate(_AUDIT))
                    taken.append(i)
                    rows.append((p["g"], ops, *[None] * 6))
                    held += len(ops)
                    if held > PIECE:
                        yield flush()
                        taken, rows, held = [], [], 0
                letter = np.frombuffer(text, np.uint8) - 65
                faults, initials = np.bincount(letter & 3, minlength=4), letter >> 2
                pairs = initials[:-1] * 4 + initials[1:]
                illegal = len(pairs) - int(np.isin(pairs, (4 * S + U, 4 * U + A, 4 * A + U)).sum())
                taken.append(i)
                rows.append((None, None, cost, int(faults[BLANK]), int(faults[REPEATED]), int(faults[CUT_OFF]), illegal, "".join(audit)))
            if rows:
                yield flush()

    return written(convs.mapInArrow(solve, ops_schema), "dialogue-edits")


def gaps(rows: DataFrame) -> DataFrame:
    """Missing turns per conversation: the span of turns less the distinct ones."""
    each = rows.groupBy("conv", "turn").agg(F.count(F.lit(1)))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return each.groupBy("conv").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired rows ``(conv, role, text)``.

    A conversation's rows come in order and in one partition. Edits and texts meet by a
    shuffle by conversation and a sort by place; an edit stands before its row.
    """
    conv = rows.schema["conv"]
    texts = rows.select("conv", "g", F.lit(1).alias("kind"), "role", "text")
    ops = edits.where("ops IS NOT NULL").select("conv", "g", F.posexplode("ops").alias("pos", "text"))
    ops = ops.select("conv", (F.col("g") + F.col("pos")).alias("g"), F.lit(0).alias("kind"), F.lit("").alias("role"), "text")
    both = ops.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "g", "kind")
    schema = T.StructType([conv]).add("role", "string").add("text", "string")

    def apply(batches):
        token = None
        for batch in batches:
            for part in slices(batch, "text"):
                taken, roles, texts = [], [], []
                for i, (kind, role, text) in enumerate(zip(*[part.column(c).to_pylist() for c in ("kind", "role", "text")])):
                    if kind == 0:
                        token = text
                        continue
                    for letter in token:
                        if letter != "D":
                            taken.append(i)
                            roles.append(role if letter == "K" else _NAMES[letter])
                            texts.append("" if letter in "ua" else text)
                if taken:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("conv").take(pa.array(taken, pa.int64())), pa.array(roles, pa.string()), pa.array(texts, pa.string())],
                        ["conv", "role", "text"],
                    )

    return both.mapInArrow(apply, schema)


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` of a conversation's rows, joined by newlines; rows as ``repaired`` gives them."""

    def hashed(batches):
        names, current, state = ["conv", "sha256"], None, None
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for key, role, text in zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if state is None or key != current:
                    if state is not None:
                        out.append((current, state.hexdigest()))
                    current, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.column(0).type), pa.array([o[1] for o in out])], names)
            kind = batch.column(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([state.hexdigest()])], names)

    return rows.mapInArrow(hashed, T.StructType([rows.schema["conv"]]).add("sha256", "string"))


def repair(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Facts per conversation and the repaired rows.

    The facts: ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``
    (adjacent roles that do not follow each other), ``cost`` and ``audit``.
    """
    placed = ordered(rows, conv, turn, role, text)
    edits = solved(symbols(placed))
    found = edits.where("audit IS NOT NULL").drop("g", "ops")
    facts = found.unionByName(gaps(placed), allowMissingColumns=True).groupBy("conv")
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return facts.agg(*[F.max(c).alias(c) for c in columns]), repaired(placed, edits)
