"""Word shingles of whole texts as 64-bit hashes, computed on the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from .common import distinct, in_runs

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)[_LOWER]
_WINDOW = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
_KEPT_POWERS = 1 << 20
#: Bytes of texts hashed at once, few enough to stay in the cache.
_HASHED_BYTES = 1 << 17


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 2**64))
        have = np.concatenate([have, have * step])
    _powers[base] = have[:_KEPT_POWERS]  # those of a long text are made anew for it
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word (A-Z lowered, cut at ASCII white space) of texts lying one after another: hash, text number, last byte."""
    found = []
    for a, b in in_runs(np.diff(offsets).tolist(), _HASHED_BYTES):
        hashes, text, last = _hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found.append((hashes, text + a, last))
    if len(found) == 1:
        return found[0]
    kinds = np.uint64, np.int64, np.uint8
    return tuple(np.concatenate([np.zeros(0, k), *(f[i] for f in found)]) for i, k in enumerate(kinds))


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    word = ~_IS_SPACE.take(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, np.uint64)
    values = _BYTE.take(data)
    values *= _power(_BASE, n)
    np.cumsum(values, out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * _power(_INVERSE, n)[starts])
    words = np.diff(np.searchsorted(starts, offsets))
    return hashes, np.repeat(np.arange(len(words)), words), _LOWER[data[ends - 1]]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word windows; of all words if there are fewer."""
    n = len(offsets) - 1
    hashes, text, _ = word_hashes(data, offsets)
    counts = np.bincount(text, minlength=n)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    windows = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        windows += hashes[k : len(hashes) - width + 1 + k] * _WINDOW[k]
    windows = mix64(windows + np.uint64(width))
    sets = []
    for i in range(n):
        a, b = firsts[i], firsts[i + 1]
        if b - a >= width:
            sets.append(distinct(windows[a : b - width + 1]))
        elif b > a:
            short = (hashes[a:b] * _WINDOW[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(mix64(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
