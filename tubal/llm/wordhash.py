"""Hashes of words and of word windows, for many documents at a time in NumPy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20250).integers(1, 1 << 64, (2, 256), np.uint64, endpoint=False)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two hashes that stand side by side, one hash."""
    return mix(a * _C2 + ((b << np.uint64(23)) | (b >> np.uint64(41))) + _BASE)


class Words:
    """The words of several texts: ``start`` and ``end`` in ``data``, ``doc`` (index of the text)
    and ``last`` (index just past the last word of the same text)."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = _SPACE[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.first = np.searchsorted(self.start, at)  # of each text, and past the last
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.last = np.repeat(self.first[1:], self.counts)

    def hashes(self, kind: int = 0) -> np.ndarray:
        raw = np.frombuffer(self.data, np.uint8)
        _grow(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[kind][raw] * _powers[0][: len(raw)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * _powers[1][self.start] + (self.end - self.start).astype(np.uint64))


def wider(low: np.ndarray, high: np.ndarray, shift: int) -> np.ndarray:
    """Hash of the window that starts with ``low[i]`` and ends with ``high[i + shift]``; entries
    whose second part lies past the end are left over from the first."""
    out = low.copy()
    n = max(0, len(low) - shift)
    out[:n] = pair(low[:n], high[shift:])
    return out
