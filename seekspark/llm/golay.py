"""The binary Golay code [23, 12] as a fuzzy hash of 23-bit words, in numpy.

Every 23-bit word is within 3 bits of exactly one codeword. The codewords nearest to a word and to its 23
one-bit neighbours, at most six different ones, are the word's keys. Two words that differ in at most two bits
have a word in common that is within one bit of both, and so a key in common.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code (fixed value).
GENERATOR = 0b110001110101
BITS, CHECKS = 23, 11


def _syndrome_of(word: int) -> int:
    for bit in range(BITS - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


def _build() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    unit = [_syndrome_of(1 << b) for b in range(BITS)]
    leader = np.zeros(1 << CHECKS, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(BITS), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            leader[s] = sum(1 << b for b in bits)

    def linear(width: int, shift: int) -> np.ndarray:
        out = np.zeros(1 << width, np.int64)
        for b in range(width):
            out[1 << b : 2 << b] = out[: 1 << b] ^ unit[b + shift]
        return out

    # What to flip in a word of each syndrome to reach the codewords of the word and its one-bit neighbours.
    flips = np.zeros((1 << CHECKS, 6), np.int64)
    number = np.zeros(1 << CHECKS, np.int64)
    for s in range(1 << CHECKS):
        own = dict.fromkeys([int(leader[s])] + [int(leader[s ^ unit[b]]) ^ (1 << b) for b in range(BITS)])
        number[s] = len(own)
        flips[s, : len(own)] = list(own)
    return leader, linear(12, 0), linear(11, 12), flips, number


_LEADER, _LOW, _HIGH, _FLIPS, _NUMBER = _build()


def syndromes(words: np.ndarray) -> np.ndarray:
    return _LOW[words & 0xFFF] ^ _HIGH[words >> 12]


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of each word's nearest codeword."""
    return (words ^ _LEADER[syndromes(words)]) >> CHECKS


def ball_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit indices of each word's keys, (n, 6), the word's own codeword first, and how many of the six count."""
    s = syndromes(words)
    return (words[:, None] ^ _FLIPS[s]) >> CHECKS, _NUMBER[s]
