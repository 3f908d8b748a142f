"""Words of UTF-8 text as hashes, in numpy.

A word is a run of ASCII letters and digits and of bytes from 0x80 on; A-Z and the capital letters
of Latin-1 count as small. Everything else separates words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FACTOR = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Words:
    """Hashes of all words of a buffer, their byte places, and the word number at which each row starts (and the end)."""

    hashes: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    rows: np.ndarray


def powers(n: int) -> np.ndarray:
    out = np.full(n, _FACTOR, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    folded = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded[1:][capital] += 32
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begin)
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:-1]
    stops = np.flatnonzero(finish) + 1
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.empty(0, np.uint64), starts, stops, rows)
    at = np.flatnonzero(inside)
    sizes = stops - starts
    first = np.cumsum(sizes) - sizes
    value = (folded[at].astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[np.arange(len(at)) - np.repeat(first, sizes)]
    h = np.add.reduceat(value, first) + sizes.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return Words(h ^ (h >> np.uint64(29)), starts, stops, rows)


def word_hashes(text: bytes) -> np.ndarray:
    return words(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hashes
