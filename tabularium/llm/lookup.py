"""Places of 64-bit keys in a table, for whole arrays of keys at once."""

from __future__ import annotations

import numpy as np


class Lookup:
    """Places of 64-bit hashes in a table: by slot, or by search where several share one."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(10, int(2 * len(keys) + 1).bit_length()))
        slots = self._slot(keys)
        self.first = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.first[slots[::-1]] = np.arange(len(keys))[::-1]
        rest = np.flatnonzero(self.first[slots] != np.arange(len(keys)))
        self.rest = rest[np.argsort(keys[rest])]
        self.crowded = np.zeros(len(self.first), bool)
        self.crowded[slots[rest]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it has none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        slots = self._slot(keys)
        at = self.first[slots]
        at[self.keys[at] != keys] = -1
        if len(self.rest):
            open_ = np.flatnonzero((at < 0) & self.crowded[slots])
            place = np.minimum(np.searchsorted(self.keys[self.rest], keys[open_]), len(self.rest) - 1)
            hit = self.keys[self.rest][place] == keys[open_]
            at[open_[hit]] = self.rest[place[hit]]
        return at
