"""Words and their hashes for whole texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

from folioscope.functions.hashing import SPACE, _power_tables, mix, word_hashes


def spaced(text: str | None) -> np.ndarray:
    """The UTF-8 bytes of the words, one space before, between and after them (a single space if there are none)."""
    words = text.split() if text else []
    return np.frombuffer((" " + " ".join(words) + " ").encode() if words else b" ", np.uint8)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive words, in order; of the whole sequence if it is shorter, none if it is empty."""
    n = min(n, len(hashes))
    if not n:
        return hashes[:0]
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = mix(total + hashes[k : len(hashes) - n + 1 + k])
    return total
