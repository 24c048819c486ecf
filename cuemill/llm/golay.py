"""Fuzzy keys from the perfect binary Golay code of length 23.

Every 23-bit word lies within three errors of exactly one codeword. The keys of a word are the
codewords that it and its neighbours (one bit flipped) decode to: one key if the word has at most two
errors, six if it has three. Two words that differ in at most two bits have a neighbour in common,
and so a key in common.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
MOST_KEYS = 6


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit word's bytes, and the error of each syndrome."""
    units = [_remainder(1 << k) for k in range(24)]
    parts = np.zeros((3, 256), np.uint32)
    for part in range(3):
        for bit in range(8):
            parts[part, np.arange(256) >> bit & 1 == 1] ^= units[8 * part + bit]
    errors = np.zeros(1 << CHECK, np.uint32)
    for n in (1, 2, 3):
        for places in combinations(range(LENGTH), n):
            syndrome = 0
            for k in places:
                syndrome ^= units[k]
            errors[syndrome] = sum(1 << k for k in places)
    return parts, errors


_PARTS, _ERRORS = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the nearest codeword of each word."""
    w = words.astype(np.uint32)
    syndrome = _PARTS[0][w & 255] ^ _PARTS[1][w >> 8 & 255] ^ _PARTS[2][w >> 16]
    return (w ^ _ERRORS[syndrome]) >> CHECK


def keys(words: np.ndarray, bits: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(keys, valid), both n by 6: the distinct keys of words that use the lowest bits only."""
    flips = np.concatenate(([0], 1 << np.arange(bits))).astype(np.uint32)
    found = np.sort(decode(words.astype(np.uint32)[:, None] ^ flips), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    order = np.argsort(~new, axis=1, kind="stable")[:, :MOST_KEYS]
    return np.take_along_axis(found, order, 1), np.take_along_axis(new, order, 1)
