"""Words of UTF-8 texts and their hashes, by whole-array arithmetic."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from lares.llm.tables import SLICE_BYTES, Texts

#: Space, tab, line feed, vertical tab, form feed, carriage return: everything else belongs to a word.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(NamedTuple):
    """Word i is data[starts[i]:ends[i]]; text d has the words first[d] to first[d + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


#: Bytes whose words are hashed at a time; a longer word is taken whole.
HASHED = 1 << 18
#: Powers that a worker keeps of each base: enough for a slice of texts. Those of a longer text are made for it alone.
_KEPT_POWERS = SLICE_BYTES + (1 << 18)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ... base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(((n >> 18) + 1) << 18, base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if len(known) <= _KEPT_POWERS:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def find_words(texts: Texts, between: np.ndarray = IS_SPACE) -> Words:
    """The maximal runs of bytes that don't part words. between: True for the bytes that do."""
    inside = ~between[texts.data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    filled = texts.offsets[:-1][texts.offsets[1:] > texts.offsets[:-1]]
    begins[filled] = inside[filled]
    last = texts.offsets[1:][texts.offsets[1:] > texts.offsets[:-1]] - 1
    stops[last] = inside[last]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, texts.offsets))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of the bytes, for span_hashes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, the same wherever it stands."""
    plain = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mix(plain + (ends - starts).astype(np.uint64))


def word_hashes(texts: Texts, words: Words, lower: bool = True) -> np.ndarray:
    """The hash of each word. Bytes are taken in blocks, so that the arrays of 64 bits a byte stay small."""
    hashes, row = np.empty(len(words.starts), np.uint64), 0
    while row < len(hashes):
        a = words.starts[row]
        stop = max(row + 1, int(np.searchsorted(words.ends, a + HASHED, "right")))
        data = texts.data[a : words.ends[stop - 1]]
        sums = prefix_hashes(LOWER[data] if lower else data)
        hashes[row:stop] = span_hashes(sums, words.starts[row:stop] - a, words.ends[row:stop] - a)
        row = stop
    return hashes


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each `width` neighbouring items, without regard to text ends."""
    n = max(0, len(hashes) - width + 1)
    total = np.full(n, width, np.uint64)
    for i, odd in enumerate(_BYTE_VALUES[:width]):
        total += hashes[i : i + n] * odd
    return mix(total)
