"""Words of many texts at once: numpy over their UTF-8 bytes, 64-bit hashes of words and of word n-grams.

Words and n-grams are compared by these hashes, which nobody chose texts against: of n different ones, about n * n / 2**65 pairs share
their hash by chance.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
#: White space of the word patterns here: space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as many as were asked for so far."""

    up = np.ones(1, _U)
    down = np.ones(1, _U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, base, _U)
                p[0] = 1
                setattr(cls, name, np.cumprod(p, dtype=_U))
        return cls.up, cls.down


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, cut at row bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    return np.flatnonzero(inside & (before | cut[:-1])), np.flatnonzero(inside & (after | cut[1:])) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans; equal bytes, equal hashes, wherever they stand."""
    up, down = _Powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (bytes between white space, A-Z lower-cased) and the number of words of each row."""
    low = LOWER[data]
    starts, ends = runs(~SPACE[data], bounds)
    per_row = np.diff(np.searchsorted(starts, bounds))
    return span_hashes(low, starts, ends), per_row


def _place(k: int) -> np.uint64:
    """The odd factor of a run's k-th word."""
    return mix(np.array([k + 1], _U))[0] | _U(1)


def shingles(hashes: np.ndarray, per_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and how many each row has; a row with fewer words has one, of all its words."""
    first = np.concatenate([[0], np.cumsum(per_row)])
    counts = np.where(per_row >= size, per_row - size + 1, (per_row > 0).astype(per_row.dtype))
    row = np.repeat(np.arange(len(per_row)), counts)
    at = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + first[row]
    have = np.minimum(per_row, size)[row]
    out = have.astype(_U)
    padded = np.concatenate([hashes, np.zeros(size, _U)])
    for k in range(size):
        out = out + np.where(have > k, padded[at + k] * _place(k), _U(0))
    return mix(out), counts
