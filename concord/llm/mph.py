"""A minimal perfect hash over distinct 64-bit keys, built and probed by array operations.

Level by level, keys are thrown into twice as many bits as there are keys left; those
alone in their bit stay, the others go on. A key's slot is the rank of its bit. Empty arrays make an empty table.
"""

from __future__ import annotations

import pickle

import numpy as np

LOAD, LEVELS, SALTS = 2, 64, 16


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _folded(h1: np.ndarray, h2: np.ndarray, salt: int) -> np.ndarray:
    """One key for a pair: its second half, or with a salt that half crossed with the mixed first."""
    return h2 if not salt else (h2.view(np.uint64) ^ _mixed(h1, LEVELS + salt)).view(np.int64)


class MinimalPerfectHash:
    def __init__(self, levels: list[np.ndarray], sizes: list[int], rest: np.ndarray, salt: int = 0):
        self.levels, self.sizes, self.rest, self.salt = levels, sizes, rest, salt
        self.before, n = [], 0  # ranks at the start of each byte of each level
        for bits in levels:
            counts = np.bitwise_count(bits)
            ranks = n + np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            self.before.append(ranks[:-1])
            n = int(ranks[-1])
        self.n = n

    @classmethod
    def over(cls, h1: np.ndarray, h2: np.ndarray) -> MinimalPerfectHash:
        """Over distinct pairs. Pairs that share their second half are told apart by a salted mixture of both halves."""
        for salt in range(SALTS):
            keys = _folded(h1, h2, salt)
            if len(np.unique(keys)) == len(keys):
                table = cls.build(keys)
                table.salt = salt
                return table
        raise ValueError("pairs repeat")

    def slots_of(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self.slots(_folded(h1, h2, self.salt))

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        left, levels, sizes = np.unique(keys), [], []
        if len(left) != len(keys):
            raise ValueError("keys repeat")
        for level in range(LEVELS):
            if not len(left):
                break
            size = LOAD * len(left) + 7
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(levels, sizes, left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; of keys that weren't built in, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, size, before) in enumerate(zip(self.levels, self.sizes, self.before, strict=True)):
            at = (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            byte = bits[at >> 3]
            there = (byte >> (at & 7).astype(np.uint8)) & 1 == 1
            hit = at[there]
            below = byte[there] & ((1 << (hit & 7)) - 1).astype(np.uint8)
            out[left[there]] = before[hit >> 3] + np.bitwise_count(below)
            left = left[~there]
        if len(self.rest) and len(left):
            where = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            out[left] = np.where(self.rest[where] == keys[left], self.n + where, -1)
        return out

    def dump(self) -> bytes:
        return pickle.dumps((self.levels, self.sizes, self.rest, self.salt), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> MinimalPerfectHash:
        return cls(*pickle.loads(data))
