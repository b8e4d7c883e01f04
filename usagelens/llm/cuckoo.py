"""A cuckoo filter over digests: small fingerprints, insertion, deletion, growth."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 200
PAIR = 0x5BD1E995


class CuckooFilter:
    """Four fingerprints of 16 bits a bucket; zero marks a free slot.

    A digest has two possible buckets; the second follows from the first and the
    fingerprint, so entries can move and be removed without the digest. `insert`
    says False when the table is too full: the owner then builds a larger one
    from its stored digests (`of`), because fingerprints alone cannot be rehashed.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.rows = [[0] * SLOTS for _ in range(buckets)] if table is None else table.reshape(-1, SLOTS).tolist()

    @staticmethod
    def room(keys: int) -> int:
        """Buckets (a power of two) for so many keys at a load of at most 80 %."""
        return 1 << max(3, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))

    @classmethod
    def of(cls, digests, buckets: int | None = None) -> CuckooFilter:
        """A filter that holds all `digests`; doubles until they fit."""
        buckets = buckets or cls.room(len(digests))
        while True:
            made = cls(buckets)
            if all(made.insert(d) for d in digests):
                return made
            buckets *= 2

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "big") or 1
        first = int.from_bytes(digest[10:16], "big") & (self.buckets - 1)
        return mark, first, first ^ (mark * PAIR & (self.buckets - 1))

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return mark in self.rows[a] or mark in self.rows[b]

    def insert(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        for place in (a, b):
            if 0 in (row := self.rows[place]):
                row[row.index(0)] = mark
                return True
        undo, place = [], b
        for turn in range(KICKS):
            slot = (mark + turn) % SLOTS
            undo.append((place, slot, self.rows[place][slot]))
            self.rows[place][slot], mark = mark, self.rows[place][slot]
            place ^= mark * PAIR & (self.buckets - 1)
            if 0 in (row := self.rows[place]):
                row[row.index(0)] = mark
                return True
        for place, slot, old in reversed(undo):
            self.rows[place][slot] = old
        return False

    def delete(self, digest: bytes) -> bool:
        """Remove one entry of a digest that is known to be stored."""
        mark, a, b = self.places(digest)
        for place in (a, b):
            if mark in (row := self.rows[place]):
                row[row.index(mark)] = 0
                return True
        return False

    def to_bytes(self) -> bytes:
        return np.array(self.rows, dtype="<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, dtype="<u2")
        return cls(len(table) // SLOTS, table)
