"""White-space words of UTF-8 texts as 64-bit hashes, many texts at once."""

from __future__ import annotations

import numpy as np

from .common import kept_in_worker

U = np.uint64
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
with np.errstate(over="ignore"):
    # One random value for each byte; the bytes A-Z have those of a-z.
    RAW_VALUE = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
BYTE_VALUE = RAW_VALUE[_LOWER]
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _made(size: int) -> tuple[np.ndarray, np.ndarray]:
    steps = [np.full(size, b, U) for b in (_BASE, _INVERSE)]
    for s in steps:
        s[0] = 1
    return tuple(np.cumprod(s, dtype=U) for s in steps)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    usual = CHUNK + (1 << 16)
    return kept_in_worker("powers", lambda: _made(usual)) if n <= usual else _made(n)


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> tuple[np.ndarray, np.ndarray]:
    """Running sums S and inverse powers I with hash(a, b) = (S[b] - S[a]) * I[a]."""
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(values[data] * power[:len(data)], out=sums[1:])
    return sums, inverse


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses a row."""
    solid = ~IS_SPACE[data]
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()):
    """(first word of each row, hashes, [hashes of the words' first k bytes, 0 where not longer than k])."""
    if len(data) == 0:
        return np.zeros(len(offsets), np.int64), np.zeros(0, U), [np.zeros(0, U) for _ in prefixes]
    starts, ends = word_spans(data, offsets)
    hashes, heads = np.empty(len(starts), U), [np.zeros(len(starts), U) for _ in prefixes]
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):  # chunks of whole words
            base = starts[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            part = data[base:ends[hi - 1]]
            a, b = starts[lo:hi] - base, ends[lo:hi] - base
            sums, inverse = prefix_sums(part)
            hashes[lo:hi] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U))
            for k, head in zip(prefixes, heads):
                long = np.flatnonzero(b - a > k)
                head[lo + long] = mix((sums[a[long] + k] - sums[a[long]]) * inverse[a[long]] + U(1 << 40 | k))
            lo = hi
    return np.searchsorted(starts, offsets), hashes, heads
