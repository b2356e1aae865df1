"""What a worker has learnt about pieces of text, by their hashes, for lookups of whole batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Learn = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


class Learnt:
    """Ids and numbers of pieces. Lookups are array operations; only pieces not met before are learnt.

    ``most`` bounds the memory: beyond it the store starts afresh.
    """

    def __init__(self, most: int, numbers: int):
        self.most, self.width = most, numbers
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.numbers = np.zeros((0, self.width))

    def slots(self, hashes: np.ndarray, learn: Learn) -> np.ndarray:
        """Row of every piece. ``learn`` gets the positions of the pieces to learn and returns ids, where each piece's begin, how many it has, and its numbers."""
        keys, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(slot, len(self.keys) - 1)] != keys
        if new.any():
            if len(self.keys) and len(self.keys) + int(new.sum()) > self.most:
                self.clear()
                new[:] = True
            ids, first, n, numbers = learn(sample[new])
            put = np.searchsorted(self.keys, keys[new])
            self.at = np.insert(self.at, put, first + len(self.ids))
            self.n = np.insert(self.n, put, n)
            self.numbers = np.insert(self.numbers, put, numbers, axis=0)
            self.keys = np.insert(self.keys, put, keys[new])
            self.ids = np.concatenate([self.ids, ids])
            slot = np.searchsorted(self.keys, keys)
        return slot[back]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the number of ids of each."""
        n = self.n[slots]
        total = np.cumsum(n)
        if not len(n) or not total[-1]:
            return np.zeros(0, np.uint32), n
        return self.ids[np.repeat(self.at[slots] - (total - n), n) + np.arange(int(total[-1]))], n
