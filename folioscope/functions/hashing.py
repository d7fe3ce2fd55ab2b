"""64-bit hashes of the words of whole texts, as numpy arrays."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = 32


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_STEP**i`` and its inverse for i < n, modulo 2**64; the tables grow with the longest text seen."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_STEP, _BACK)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hashes) of the words in ``data``, which begins and ends with a space."""
    gaps = np.flatnonzero(data == SPACE)
    starts, ends = gaps[:-1] + 1, gaps[1:]
    full = ends > starts
    starts, ends = starts[full], ends[full]
    forward, backward = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * backward[starts]
    return starts, ends, mix(hashes)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))
