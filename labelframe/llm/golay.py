"""Binary Golay code (23, 12, 7): nearest codewords of 23-bit words, vectorised.

The code is perfect: each word lies within three bits of exactly one codeword. ``near_indices``
gives the indices of all codewords within four bits: one for a word at distance two or less from
its codeword, and six for a word at distance three (its own, and the five that a weight-seven
codeword covering its error pattern leads to). Two words that differ in at most two bits have a
common index: both lie within one bit of a word between them, whose codeword is within three bits
of that word and so within four of either.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, DATA_BITS, PARITY_BITS = 23, 12, 11
#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, PARITY_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - PARITY_BITS)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of the low 12 bits, syndrome of the high 11 bits, error by syndrome, index deltas by syndrome)."""
    unit = [_remainder(1 << b) for b in range(LENGTH)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for table, first in ((low, 0), (high, 12)):
        for value in range(1, len(table)):
            bit = value.bit_length() - 1
            table[value] = table[value ^ (1 << bit)] ^ unit[first + bit]
    error = np.zeros(1 << PARITY_BITS, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(LENGTH), weight):
            error[np.bitwise_xor.reduce([unit[p] for p in places])] = sum(1 << p for p in places)
    data = np.arange(1 << DATA_BITS, dtype=np.int64) << PARITY_BITS
    codewords = data | low[data & 0xFFF] ^ high[data >> 12]
    seven = codewords[np.bitwise_count(codewords) == 7]
    deltas = np.full((1 << PARITY_BITS, 6), -1, np.int64)
    deltas[:, 0] = 0
    for s, e in enumerate(error):
        if int(e).bit_count() == 3:
            deltas[s, 1:] = np.sort(seven[seven & e == e] >> PARITY_BITS)
    return low, high, error, deltas


def nearest_index(words: np.ndarray) -> np.ndarray:
    """Index (the 12 data bits) of each word's own codeword."""
    low, high, error, _ = tables()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> PARITY_BITS


def near_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within four bits; -1 where there are fewer than six."""
    low, high, error, deltas = tables()
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    own = (words ^ error[syndrome]) >> PARITY_BITS
    more = deltas[syndrome]
    return np.where(more < 0, -1, own[:, None] ^ more)
