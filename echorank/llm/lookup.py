"""Hash tables and ragged gathers in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

from echorank.llm.words import mix

EMPTY = np.uint64(2**64 - 1)


def gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``begins``, one after the other."""
    shift = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    return flat[np.arange(len(shift)) + shift]


class Places:
    """An open hash table from distinct 64-bit keys to their places 0, 1, 2 ...

    The key 2**64 - 1 is reserved. Every key is within ``probes`` places of its own.
    """

    def __init__(self, keys: np.ndarray):
        size = 1 << int(4 * len(keys) + 3).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys, self.places = np.full(size, EMPTY), np.full(size, -1, np.int32)
        todo, at, self.probes = np.arange(len(keys)), (mix(keys) & self.mask).astype(np.int64), 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[at[todo]] == EMPTY]
            _, one = np.unique(at[free], return_index=True)
            stored = free[one]
            self.keys[at[stored]], self.places[at[stored]] = keys[stored], stored
            todo = np.setdiff1d(todo, stored, assume_unique=True)
            at[todo] = (at[todo] + 1) & int(self.mask)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not there."""
        at = (mix(keys) & self.mask).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == keys, self.places[at], np.int32(-1))
        other = np.flatnonzero((got != keys) & (got != EMPTY))
        for _ in range(self.probes - 1):
            if not len(other):
                break
            at[other] = (at[other] + 1) & int(self.mask)
            got = self.keys[at[other]]
            same = got == keys[other]
            out[other[same]] = self.places[at[other[same]]]
            other = other[~same & (got != EMPTY)]
        return out
