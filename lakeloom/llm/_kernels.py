"""Numpy kernels over UTF-8 bytes, shared by the text models of this package.

A buffer of texts is first made `spaced`: separators become blanks and one blank stands before,
between and after texts, so no n-gram spans two texts or two words' interiors.
"""

from __future__ import annotations

import numpy as np

BLANK = 0x20
_MULTIPLIER = {3: 0x9E3779B1, 4: 0x85EBCA77, 5: 0xC2B2AE3D}


def spaced(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mapped bytes with a blank around each text, where each text starts)."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, BLANK, np.uint8)
    lens = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), lens)] = table[data]
    return out, offsets[:-1] + np.arange(1, n + 1)


def ngrams(text: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, whether it counts) of the byte n-gram at each position, n from 3 to 5.

    One counts if no blank is among its inner bytes; it belongs to the word of its second byte.
    """
    size = len(text) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    at = [text[k : k + size].astype(np.uint32) for k in range(n)]
    h = at[0]
    for x in at[1:4]:
        h = h << np.uint32(8) | x
    if n > 4:
        h = h * np.uint32(0x27D4EB2F) ^ at[4]
    h = h * np.uint32(_MULTIPLIER[n])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    inner = text != BLANK
    good = inner[1 : 1 + size].copy()
    for k in range(2, n - 1):
        good &= inner[k : k + size]
    return h >> np.uint32(32 - bits), good


def word_starts(text: np.ndarray) -> np.ndarray:
    """The first byte of each word of a spaced buffer."""
    full = text != BLANK
    return np.flatnonzero(full[1:] & ~full[:-1]) + 1
