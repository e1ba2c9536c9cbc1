"""A vectorised hash table from 64-bit keys to row numbers, built and probed with numpy."""

from __future__ import annotations

import numpy as np

_NONE = np.int32(-1)


class Lookup:
    """Open addressing over at least four slots a key; ``find`` answers -1 for unknown keys."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(4 * max(1, len(keys)) - 1).bit_length())
        self.slots = np.full(1 << self.bits, _NONE, np.int32)
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))  # the last row stands for none
        waiting = np.arange(len(keys), dtype=np.int32)
        at = self._place(self.keys[:-1])
        while len(waiting):
            free = self.slots[at] == _NONE
            self.slots[at[free]] = waiting[free]
            left = self.slots[at] != waiting
            waiting, at = waiting[left], (at[left] + 1) & (len(self.slots) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        rows = self.slots[at]
        wrong = np.flatnonzero((rows >= 0) & (self.keys[rows] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            found = self.slots[at[wrong]]
            rows[wrong] = found
            wrong = wrong[(found >= 0) & (self.keys[found] != keys[wrong])]
        return rows
