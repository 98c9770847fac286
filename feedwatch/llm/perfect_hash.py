"""Minimal perfect hash of 64-bit keys: level after level of bitmaps, built and asked in whole arrays.

On each level every key left has one bit; bits that a single key has are its place, the others' keys
go on to the next level.  A key's number is the count of set bits before its own.  Keys that no level
separates (equal 64-bit hashes) are listed at the end.
"""

from __future__ import annotations

import numpy as np

from feedwatch.llm.words import mix

U = np.uint64
LOAD = 2.0  # bits of a level for each of its keys
LEVELS = 32


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % U(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys) and len(sizes) < LEVELS:
            size = (int(len(keys) * LOAD) + 63) // 64 * 64
            slots = _slots(keys, len(sizes), size)
            alone = np.bincount(slots, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[slots]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"), np.sort(keys))

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.rest)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers from 0; a key that is not in the set gets some number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            slots = _slots(keys[todo], level, size) + base
            words, bit = self.bits[slots >> 6], (slots & 63).astype(U)
            hit = (words >> bit) & U(1) == 1
            below = np.bitwise_count(words[hit] & ((U(1) << bit[hit]) - U(1)))
            out[todo[hit]] = self.before[slots[hit] >> 6] + below
            todo, base = todo[~hit], base + size
        if len(self.rest) and len(todo):
            at = np.searchsorted(self.rest, keys[todo])
            at[at == len(self.rest)] = 0
            same = self.rest[at] == keys[todo]
            out[todo[same]] = self.before[-1] + at[same]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), len(self.rest), *self.sizes], "<i8")
        return head.tobytes() + self.bits.tobytes() + self.rest.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The hash and how many bytes it took."""
        levels, rest = np.frombuffer(data, "<i8", 2).tolist()
        sizes = np.frombuffer(data, "<i8", levels, 16).tolist()
        at = 16 + 8 * levels
        words = sum(sizes) // 64
        bits = np.frombuffer(data, "<u8", words, at)
        at += 8 * words
        return cls(sizes, bits, np.frombuffer(data, "<u8", rest, at)), at + 8 * rest
