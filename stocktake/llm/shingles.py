"""Hashed word shingles of texts, alike in every process."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look random."""
    x = x.astype(np.uint64, copy=False)
    x = x ^ (x >> np.uint64(30))  # a new array, which the rest changes in place
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the step and of its inverse, kept for later calls."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, _INVERSE)):
            _powers[i] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base)]))
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte hashes times powers: the bytes from a to b hash to (sums[b] - sums[a]) * inverse power of a."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    out[1:] = _BYTE[data]
    out[1:] *= up[: len(data)]
    np.cumsum(out[1:], out=out[1:])
    return out


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of the text, A-Z in lower case."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct shingles of `size` words, as rising hashes; fewer words are one shingle; without words there is none."""
    words = word_hashes(text or "")
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    rows = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        rows = mixed(rows * _STEP + words[j : n - width + 1 + j])
    return np.unique(rows)
