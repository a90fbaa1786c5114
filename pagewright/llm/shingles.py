"""Sets of hashed word shingles, in numpy, for use inside Spark tasks."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words hashed at a time; longer texts go in segments that overlap by a shingle.
SEGMENT_WORDS = 200_000

_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words of a text.

    Words are runs of bytes other than ASCII white space, A to Z in lower case. Fewer words than ``size``
    make one shingle; no words, none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    found = [
        _hashes(words[i : i + SEGMENT_WORDS + size - 1], size)
        for i in range(0, max(1, len(words) - size + 1), SEGMENT_WORDS)
    ]
    return np.unique(np.concatenate(found) if len(found) > 1 else found[0])


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    power, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends) - size + 1]
    ends = ends[size - 1 :]
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)
