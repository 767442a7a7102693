"""A cuckoo filter over 64-bit keys: says "surely new" or "perhaps held", and forgets keys again."""

from __future__ import annotations

from itertools import count

import numpy as np

#: Slots of a bucket at first, and how many a bucket gets more when the table is full.
SLOTS = 4
#: Rounds of moving fingerprints before buckets get more slots.
ROUNDS = 200
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_PRINT = np.uint64(0x5BD1E995)


class CuckooFilter:
    """Fingerprints of 16 bits in a table of (bucket, slot); 0 is a free slot.

    A key has two buckets, and either is found from the other by the fingerprint alone,
    so that a fingerprint can be moved without its key.  When moving finds no room, every
    bucket gets more slots: keys are never lost.  A key that was added is always found;
    another one is found by chance in about 2 * slots of 65,536 cases.  Only keys that
    were added may be removed, as often as they were added.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """With room for ``keys`` keys at a load of 0.8."""
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, keys) / (0.8 * SLOTS)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes, buckets: int) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(buckets, -1).astype(np.uint16))

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _step(self, prints: np.ndarray) -> np.ndarray:
        """What leads from one bucket of a fingerprint to the other, by exclusive or."""
        mixed = (prints.astype(np.uint64) * _ODD_PRINT) >> np.uint64(8)
        return (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, first buckets) of the keys."""
        mixed = keys.astype(np.uint64) * _ODD
        mixed ^= mixed >> np.uint64(29)
        prints = np.maximum(mixed >> np.uint64(48), 1).astype(np.uint16)
        return prints, (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, here = self._places(keys)
        there = here ^ self._step(prints)
        wanted = prints[:, None]
        return (self.table[here] == wanted).any(axis=1) | (self.table[there] == wanted).any(axis=1)

    def add(self, keys: np.ndarray) -> None:
        """Add each key, all at a time: a round seats what fits and moves the rest on."""
        prints, here = self._places(keys)
        rng = np.random.default_rng(0)
        for turn in count():
            if not len(prints):
                return
            order = np.argsort(here, kind="stable")
            prints, here = prints[order], here[order]
            rank = np.arange(len(here)) - np.searchsorted(here, here)
            free = np.cumsum(self.table[here] == 0, axis=1)
            fits = free[:, -1] > rank
            slot = np.argmax(free == (rank + 1)[:, None], axis=1)
            self.table[here[fits], slot[fits]] = prints[fits]
            prints, here = prints[~fits], here[~fits]
            if turn and turn % ROUNDS == 0:
                self.table = np.pad(self.table, ((0, 0), (0, SLOTS)))
            elif turn:
                # one newcomer a bucket takes the slot of a fingerprint that moves on
                buckets, one = np.unique(here, return_index=True)
                slot = rng.integers(self.table.shape[1], size=len(one))
                moved = self.table[buckets, slot].copy()
                self.table[buckets, slot] = prints[one]
                prints[one] = moved
            here = here ^ self._step(prints)

    def remove(self, keys: np.ndarray) -> None:
        """Remove each key once; it must have been added."""
        prints, here = self._places(keys)
        there = here ^ self._step(prints)
        while len(prints):
            # equal fingerprints of one pair of buckets go one after another
            _, one = np.unique(np.minimum(here, there) * 65536 + prints, return_index=True)
            at_first = (self.table[here[one]] == prints[one, None]).any(axis=1)
            bucket = np.where(at_first, here[one], there[one])
            found = self.table[bucket] == prints[one, None]
            if not found.any(axis=1).all():
                raise KeyError("a key that was never added")
            self.table[bucket, found.argmax(axis=1)] = 0
            prints, here, there = (np.delete(x, one) for x in (prints, here, there))
