"""Minimal perfect hashes over sets of keys that one task can hold.

Level after level, the keys left over are hashed onto twice as many places; a key alone in its
place stays there, those that met go on to the next level. The slot of a key is the number of taken
places before its own, so n keys have the slots 0 to n - 1. Any other string has a slot as well, or
none; the stored keys tell which strings are keys.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Keys that still meet after so many levels, as equal hashes do, are listed.
LEVELS = 40


def hashes(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same as Spark's xxhash64 of a string."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(k, 42) for k in keys), np.uint64, len(keys))


def places(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place for each hash, independent from level to level."""
    x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """`slots` maps strings to slots, -1 for strings that are no keys; `keys` lists the keys by slot."""

    def __init__(self, keys: list[bytes], levels: list[np.ndarray], listed: dict[bytes, int]):
        self.keys, self.levels, self.listed = keys, levels, listed
        self.taken, left = [], len(keys)
        for bits in levels:  # which places are taken, and the slot of each
            alone = np.unpackbits(bits, count=2 * left).astype(bool)
            self.taken.append((alone, len(keys) - left + np.cumsum(alone) - 1))
            left -= int(alone.sum())

    @staticmethod
    def of(keys: list[bytes]) -> PerfectHash:
        """The hash of a list of different keys."""
        h, left, levels = hashes(keys), np.arange(len(keys)), []
        slot, taken = np.zeros(len(keys), np.int64), 0
        while len(left) and len(levels) < LEVELS:
            at = places(h[left], len(levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            levels.append(np.packbits(alone))
            settled = alone[at]
            slot[left[settled]] = taken + np.cumsum(alone)[at[settled]] - 1
            taken += int(settled.sum())
            left = left[~settled]
        slot[left] = taken + np.arange(len(left))
        in_order = [keys[i] for i in np.argsort(slot)]
        return PerfectHash(in_order, levels, {keys[i]: int(slot[i]) for i in left})

    def parts(self) -> tuple[list[np.ndarray], dict[bytes, int]]:
        """All but the keys, as plain values."""
        return self.levels, self.listed

    def slots(self, strings: list[bytes], h: np.ndarray) -> np.ndarray:
        found, left = np.full(len(strings), -1, np.int64), np.arange(len(strings))
        for level, (alone, slot) in enumerate(self.taken):
            at = places(h[left], level, len(alone))
            here = alone[at]
            found[left[here]] = slot[at[here]]
            left = left[~here]
        for i in left if self.listed else ():
            found[i] = self.listed.get(strings[i], -1)
        same = [s >= 0 and self.keys[s] == string for s, string in zip(found.tolist(), strings, strict=True)]
        return np.where(same, found, -1)
