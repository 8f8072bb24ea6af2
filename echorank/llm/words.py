"""Words of whole texts as 64-bit hashes, a block of bytes at a time.

Texts stay in Arrow's byte buffer: word bounds come from a table of byte classes, and
the hash of a word from prefix sums over a block of about a megabyte, cut between
words. So memory is bounded by the batch, whatever the length of a text or word.

Two different words share a hash with a probability of 2**-64; for the counts and
sets of one job over 10**9 words that is a chance of about 3 in 100.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut into words together, and hashed together.
SLICE_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20

_BYTE = np.arange(256)
#: Everything but blanks and the controls from tab to carriage return.
SPACED = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: Digits, lower-case letters and every byte of a character beyond ASCII.
ALNUM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_CODES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes byte ranges; keeps the powers of the block length."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, BLOCK_BYTES), _powers(_BASE_INVERSE, BLOCK_BYTES)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK_BYTES, "right")))
            hi = int(ends[j - 1])
            up, down = (self.up, self.down) if hi - lo <= BLOCK_BYTES else (_powers(_BASE, hi - lo), _powers(_BASE_INVERSE, hi - lo))
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_CODES[data[lo:hi]] * up[: hi - lo], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
        return out


@dataclass
class Words:
    """Words of some texts: byte ranges in ``data``, hashes, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len(texts) + 1 places in the arrays above

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets in them; NULL is empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``limit`` bytes of text; a longer text comes alone."""
    if batch.num_rows == 0:
        return
    _, offsets = buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def cut(texts: pa.Array, word_bytes: np.ndarray, hasher: Hasher) -> Words:
    """The words of each text in order, A-Z in lower case."""
    raw, offsets = buffers(texts)
    data = LOWER[raw]
    inside = word_bytes[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, hasher(data, starts, ends), np.searchsorted(starts, offsets))
