"""A minimal perfect hash over 64-bit keys, with the keys stored by slot.

Level by level, every key that is left is hashed to a place in a bit table a few times their number; keys alone at
their place are settled there, the others go to the next level. A key's slot is the number of settled places before
its own. Keys that are not in the table are told apart by the key stored at the slot they are led to.
"""

from __future__ import annotations

import numpy as np

#: Places for each key of a level, and levels at most; keys left after the last are found by binary search.
ROOM, LEVELS = 2.0, 48


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one mixing of 64-bit values (two rounds of shift and multiply)."""
    h = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """keys: distinct int64 values. Slots are 0 to len(keys) - 1."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.int64)
        self.sizes: list[int] = []
        self.bits: list[np.ndarray] = []
        left = keys.view(np.uint64)
        while len(left) and len(self.sizes) < LEVELS:
            size = max(64, int(ROOM * len(left)))
            at = (mixed(left, len(self.sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            self.bits.append(alone)
            left = left[~alone[at]]
        self.first = np.cumsum([0, *[int(b.sum()) for b in self.bits]])
        # Settled places before each place: one number for 64 places, the rest is counted.
        self.words = [np.packbits(np.pad(b, (0, -len(b) % 64)), bitorder="little").view(np.uint64) for b in self.bits]
        self.before = [np.cumsum(np.concatenate([[0], np.bitwise_count(w)])).astype(np.int64) for w in self.words]
        del self.bits
        self.rest = np.sort(left.view(np.int64))
        self.keys = np.empty(len(keys), np.int64)
        self.keys[self._slots(keys)] = keys

    def __len__(self) -> int:
        return len(self.keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot each key is led to; -1 if to none."""
        slots = np.full(len(keys), -1, np.int64)
        open_, values = np.arange(len(keys)), keys.view(np.uint64)
        for k, size in enumerate(self.sizes):
            if not len(open_):
                return slots
            at = mixed(values, k) % np.uint64(size)
            place, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            word = self.words[k][place]
            hit = (word >> bit) & np.uint64(1) == 1
            ahead = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slots[open_[hit]] = (self.first[k] + self.before[k][place] + ahead)[hit]
            open_, values = open_[~hit], values[~hit]
        if len(open_) and len(self.rest):
            keys = values.view(np.int64)
            at = np.minimum(np.searchsorted(self.rest, keys), len(self.rest) - 1)
            slots[open_] = np.where(self.rest[at] == keys, self.first[-1] + at, -1)
        return slots

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the table."""
        keys = np.ascontiguousarray(keys, np.int64)
        slots = self._slots(keys)
        if not len(self.keys):
            return slots
        return np.where((slots >= 0) & (self.keys[slots] == keys), slots, -1)
