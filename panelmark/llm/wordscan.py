"""Words, lines and their 64-bit fingerprints from UTF-8 bytes, a slice of rows at a time.

A word is a run of bytes outside space and 09-0D; these bytes never occur inside a
longer UTF-8 character, so bytes and characters give the same words. Fingerprints are
polynomials over random 64-bit values of the bytes: equal words have equal ones, and
unequal words collide with a probability near 2**-64 a pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_RNG = np.random.default_rng(20_261)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_MIX = [int(x) * 2 + 1 for x in _RNG.integers(1, 2**62, 8)]
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@lru_cache(maxsize=1)
def _powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_to(1 << max(20, int(n).bit_length()))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(32))


def span_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:end]."""
    up, down = _powers(len(data) + 1)
    summed = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=summed[1:])
    return scramble((summed[ends] - summed[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_MIX[2]))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of all words; a word never crosses the end of a row."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = _GAP[data]
    first = ~gap[:-1]
    starts_row = np.zeros(len(data) + 1, bool)
    starts_row[offsets[:-1]] = True
    first[1:] &= gap[:-2] | starts_row[1:-1]
    starts = np.flatnonzero(first)
    stop = gap | starts_row
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def windows_of(prints: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of every run of ``width`` words inside one row."""
    n = len(prints) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(rows[:n] == rows[width - 1 :])
    total = np.zeros(len(first), np.uint64)
    for k in range(width):
        total = (total ^ prints[first + k]) * np.uint64(_MIX[3 + k % 4]) + np.uint64(k + 1)
    return first, scramble(total)
