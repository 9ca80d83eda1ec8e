"""Word and word-window hashes of many texts at once, by prefix sums over their UTF-8 bytes.

A word's hash is a polynomial in an odd base modulo 2**64 over random values of its bytes. Prefix sums give
every word of a block in a few passes, as the base has an inverse; a mixing step follows.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
        if n <= 1 << 22:  # longer tables, for a very long text, are made anew
            _powers[base] = out
        return out[:n]
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that ``is_word`` (256 booleans) marks: starts, ends, and each text's first word index."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    edge = np.diff(inside)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    cut = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]  # a word may not run on into the next text
    if len(cut):
        cut = np.unique(cut)
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    return mixed((total[ends] - total[starts]) * _power(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; runs over text borders are for the caller to drop."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    h = np.full(n, np.uint64(width))
    for k in range(width):
        h = h * _STEP + words[k : k + n]
    return mixed(h)


#: A-Z as a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
