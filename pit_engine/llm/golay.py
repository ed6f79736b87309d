"""The binary Golay code of length 23: tables for fuzzy hashing.

The code is perfect: every 23-bit word lies within 3 bits of exactly one of the
4,096 codewords. A word within 2 bits of its codeword has no other codeword
within 4 bits; a word at 3 bits has five more. If two words differ in one bit,
the codeword of either lies within 4 bits of the other, so one side gives one
key, the other side one or six, and they share a key.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, INDEX_BITS = 23, 12
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the generator polynomial (fixed value).
GENERATOR = 0b101011100011
#: Codewords within 4 bits of a word, at most.
NEAR = 6


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, BITS - INDEX_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (BITS - INDEX_BITS))
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the high 12 and the low 11 bits; errors of up to 4 bits by remainder, and how many."""
    parity = BITS - INDEX_BITS
    high = np.array([_remainder(i << parity) for i in range(1 << INDEX_BITS)], np.uint32)
    single = [_remainder(1 << b) for b in range(BITS)]
    errors: list[list[int]] = [[] for _ in range(1 << parity)]
    for weight in range(5):
        for at in combinations(range(BITS), weight):
            r = e = 0
            for b in at:
                r ^= single[b]
                e |= 1 << b
            errors[r].append(e)
    count = np.array([len(e) for e in errors], np.int64)
    # Short lists are filled up with their first entry, the error of the word's own codeword.
    padded = np.array([e + e[:1] * (NEAR - len(e)) for e in errors], np.uint32)
    return high, np.arange(1 << parity, dtype=np.uint32), padded, count


def own_index(words: np.ndarray) -> np.ndarray:
    """The index of the codeword nearest to each 23-bit word."""
    high, low, errors, _ = tables()
    r = high[words >> 11] ^ low[words & 0x7FF]
    return (words ^ errors[r, 0]) >> 11


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within 4 bits of each word (n x 6), and how many of them are real."""
    high, low, errors, count = tables()
    r = high[words >> 11] ^ low[words & 0x7FF]
    return (words[:, None] ^ errors[r]) >> 11, count[r]
