"""A Bloom filter with two published 32-bit string hashes over UTF-16 units."""

from __future__ import annotations

import math

from quillspark.kernels import jsstr

MASK = 0xFFFFFFFF


def fnv1a(text: str) -> int:
    """FNV-1a, 32 bits."""
    h = 0x811C9DC5
    for c in jsstr.units(text):
        h = ((h ^ ord(c)) * 0x01000193) & MASK
    return h


def djb2(text: str) -> int:
    """DJB2 (times 33, plus), 32 bits."""
    h = 5381
    for c in jsstr.units(text):
        h = (h * 33 + ord(c)) & MASK
    return h


class Bloom:
    """Sized for ``items`` keys at false positive rate ``rate``."""

    def __init__(self, items: int, rate: float) -> None:
        if items <= 0 or not 0 < rate < 1:
            raise ValueError("need items > 0 and 0 < rate < 1")
        self.bits = math.ceil(-items * math.log(rate) / math.log(2) ** 2)
        self.hashes = max(1, min(32, math.floor(self.bits / items * math.log(2) + 0.5)))
        self.store = bytearray(-(-self.bits // 8))

    def indices(self, key: str) -> list[int]:
        """Bit positions of a key; the sum wraps at 32 bits before the modulus."""
        a, b = fnv1a(key), djb2(key) or 1
        return [((a + i * b) & MASK) % self.bits for i in range(self.hashes)]

    def add(self, key: str) -> None:
        for i in self.indices(key):
            self.store[i >> 3] |= 1 << (i & 7)

    def __contains__(self, key: str) -> bool:
        return all(self.store[i >> 3] >> (i & 7) & 1 for i in self.indices(key))

    def popcount(self) -> int:
        """How many bits are set."""
        return sum(b.bit_count() for b in self.store)

    def merge(self, other: Bloom) -> Bloom:
        """The union, in place; both must have the same size."""
        if (self.bits, self.hashes) != (other.bits, other.hashes):
            raise ValueError("filters differ in size")
        self.store = bytearray(a | b for a, b in zip(self.store, other.store))
        return self
