"""Words of whole texts as arrays: where they start and end, and 64-bit hashes of them, computed for many texts at once."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

#: ASCII white space: space, and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

BASE = 0x9E3779B97F4A7C15
ODD = tuple(int(x) | 1 for x in np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64))


@cache
def _values() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of BASE modulo 2^64, and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((BASE, pow(BASE, -1, 2**64))):
            run = np.full(max(n, 1 << 20), x, np.uint64)
            run[0] = 1
            _POWERS[k] = np.multiply.accumulate(run)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit values so that every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


#: Spans of more bytes than this are hashed one by one with BLAKE2b.
LANES = 256


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes give equal hashes, on every executor.

    Eight bytes at a time are mixed into the hash of those before them, so no sum over byte places can cancel out.
    """
    size = np.asarray(end - start, np.int64)
    padded = np.concatenate([np.ascontiguousarray(data).view(np.uint8).ravel(), np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 7,), (1,))
    h = mix(size.astype(np.uint64) * np.uint64(ODD[62]) + np.uint64(ODD[63]))
    longest = int(size.max()) if len(size) else 0
    for lane in range(0, min(longest, LANES), 8):
        more = np.flatnonzero(size > lane)
        left = np.minimum(size[more] - lane, 8)
        block = eight[start[more] + lane] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64))
        h[more] = mix(mix(h[more] * np.uint64(BASE) + np.uint64(ODD[lane // 8])) ^ block)
    if longest > LANES:
        raw = padded.tobytes()
        for k in np.flatnonzero(size > LANES).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(raw[int(start[k]) : int(end[k])], digest_size=8).digest(), "little")
    return h


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each ``width`` bytes in a row."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values()[data] * up[: len(data)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of bytes with a gap behind each, and where each starts (one more: the end)."""
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(gap)
    return data, np.concatenate([[0], np.cumsum(sizes)])


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)
