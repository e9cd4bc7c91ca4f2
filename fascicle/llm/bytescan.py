"""Words of many texts at once, on the raw UTF-8 buffer of an Arrow array."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240611)
#: A random odd 64-bit number for each byte.
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Space, tab, and the line and form breaks part words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Whatever is neither an ASCII letter or digit nor part of a multi-byte character.
SIGNS = np.ones(256, bool)
SIGNS[0x80:] = False
for _a, _b in ("az", "AZ", "09"):
    SIGNS[ord(_a) : ord(_b) + 1] = False


def powers(n: int, base: np.uint64) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    found = _powers.get(int(base))
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, np.uint64)
        found[0] = 1
        found = np.cumprod(found, dtype=np.uint64)
        if len(found) <= 1 << 22:
            _powers[int(base)] = found
    return found[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """``start`` and ``end`` of each word in the buffer; ``first``: the index of each text's first word, and one past the last."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = BLANK):
        inside = ~gaps[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0]
        before[edges] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[edges[1:] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        low = LOWER[data]
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[low] * powers(len(data), STEP), out=self._sums[1:])
        self._back = powers(len(data), STEP_BACK)

    def _hash(self, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[self.start]) * self._back[self.start])

    def hashes(self) -> np.ndarray:
        """64 bits for each word, A to Z as a to z."""
        return self._hash(self.end)

    def stems(self, n: int) -> np.ndarray:
        """The same for the first ``n`` bytes of each word."""
        return self._hash(np.minimum(self.end, self.start + n))

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, order included; shorter by k - 1 than its input."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[j : j + n]
    return mix(out)
