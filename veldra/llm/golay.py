"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit words.

A word lies within 3 bits of exactly one codeword. Words at distance 3 have five more
codewords at distance 4. Taking all codewords within distance 4 as keys gives 1 or 6
keys of 12 bits a word, and any two words that differ in at most 2 bits share a key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 23
KEYS = 6
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(value: int) -> int:
    for at in range(BITS - 1, 10, -1):
        if value >> at & 1:
            value ^= _GENERATOR << (at - 11)
    return value


_HIGH = np.array([_remainder(x << 11) for x in range(4096)], np.uint16)


def _patterns() -> np.ndarray:
    """Error patterns by syndrome: the coset leader, then the patterns of weight 4; -1 where there are fewer."""
    table = np.full((2048, KEYS), -1, np.int32)
    filled = np.zeros(2048, int)
    for weight in range(5):
        for places in combinations(range(BITS), weight):
            word = sum(1 << p for p in places)
            syndrome = int(_HIGH[word >> 11]) ^ (word & 2047)
            if weight < 4 or (filled[syndrome] and bin(table[syndrome, 0]).count("1") == 3):
                table[syndrome, filled[syndrome]] = word
                filled[syndrome] += 1
    return table


_PATTERNS = _patterns()


def keys(words: np.ndarray) -> np.ndarray:
    """Codeword indices (0 to 4095) within distance 4 of each 23-bit word: shape (n, 6), padded with -1."""
    words = words.astype(np.int32)
    errors = _PATTERNS[_HIGH[words >> 11] ^ (words & 2047)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11).astype(np.int16)
