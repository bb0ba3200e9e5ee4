"""Word shingles, set fingerprints and min-max signatures, with numpy over UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lakeloom.llm._common import spans, utf8
from lakeloom.llm._kernels import spaced, word_starts
from lakeloom.llm.bpe import slice_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 0x20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each text, ascending.

    A text of fewer words is one shingle; one without words has none.
    """
    n = len(offsets) - 1
    text, begin = spaced(data, offsets, _LOWER)
    start = word_starts(text)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    end = np.flatnonzero((text[1:] == 0x20) & (text[:-1] != 0x20)) + 1
    w = slice_hashes(text, start, end)
    doc = np.searchsorted(begin, start, "right") - 1
    size = np.bincount(doc, minlength=n)
    first = np.cumsum(size) - size
    h = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for k in range(words):
        h = h * _STEP + w[k : k + len(h)]
    whole = doc[: len(h)] == doc[words - 1 :] if len(h) else np.zeros(0, bool)
    hashes, owner = [mix(h[whole] + np.uint64(words))], [doc[: len(h)][whole]]
    for c in range(1, words):
        few = np.flatnonzero(size == c)
        if len(few):
            h = np.zeros(len(few), np.uint64)
            for k in range(c):
                h = h * _STEP + w[first[few] + k]
            hashes.append(mix(h + np.uint64(c)))
            owner.append(few)
    h, doc = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))])


def batches_of_sets(texts: pa.Array, words: int):
    """(first text, last text, hashes, offsets) over pieces of a string array."""
    data, offsets = utf8(texts)
    for lo, hi in spans(offsets):
        yield lo, hi, *shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(99)
    return rng.integers(0, 2**64, count, np.uint64) | np.uint64(1), rng.integers(0, 2**64, count, np.uint64)


def min_max(hashes: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """Signatures of 2 * count values: the minima, then the maxima, under each permutation.

    Every set must have a shingle. One evaluation per shingle and permutation gives two values.
    """
    out = np.empty((len(offsets) - 1, 2 * count), np.uint32)
    at = 0
    while at < len(out):  # pieces that stay in cache
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 16384, "right")) - 1)
        h, starts = hashes[offsets[at] : offsets[end]], offsets[at:end] - offsets[at]
        for p, (a, b) in enumerate(zip(*permutations(count))):
            x = (h ^ b) * a
            out[at:end, p] = np.minimum.reduceat(x, starts) >> np.uint64(32)
            out[at:end, count + p] = np.maximum.reduceat(x, starts) >> np.uint64(32)
        at = end
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values; values are dealt to bands at random, but fixed."""
    deal = np.random.default_rng(5).permutation(signatures.shape[1])
    bands = signatures.shape[1] // rows
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signatures), b, np.uint64)
        for c in deal[b * rows : (b + 1) * rows]:
            h = mix(h * _STEP + signatures[:, c])
        keys[:, b] = h
    return keys


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    both = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(salt)))])
        both.append(total[offsets[1:]] - total[offsets[:-1]])
    return both[0], both[1]
