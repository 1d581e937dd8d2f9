"""Content-defined anchors of byte strings: leftmost minimisers of all windows of a fixed length.

Every window of ``window`` bytes owns one anchor: the leftmost of its k-grams with the least hash. Windows with one
anchor are consecutive, and equal windows have their anchor at the same place, whatever surrounds them. So strings that
share a window share an anchor's k-gram, and what an anchor's own windows cover is its context.
"""

from __future__ import annotations

import numpy as np

K = 32
_FACTORS = [0x9E3779B97F4A7C15]
while len(_FACTORS) < 5:
    _FACTORS.append(_FACTORS[-1] * _FACTORS[-1] % (1 << 64))
#: Bytes of a text that are hashed at once.
PART = 1 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of every k-gram of bytes; doubling: a gram's hash from its halves' hashes."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    size = 1
    for f in _FACTORS:
        h = h[:-size] * np.uint64(f) + h[size:]
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _part(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the anchor's place, and the hashes of all grams."""
    h = gram_hashes(data)
    place = np.uint64((1 << 21) - 1)
    least = _sliding_min((h & ~place) | np.arange(len(h), dtype=np.uint64), window - K + 1)
    return (least & place).astype(np.int64), h


def anchors(data: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes, first own window starts and last own window starts, in order; empty below one window."""
    raw, n = np.frombuffer(data, np.uint8), len(data)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none, none
    found = []
    for lo in range(0, n - window + 1, PART):
        at, h = _part(raw[lo : min(n, lo + PART + window - 1)], window)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], len(at)) - 1
        found.append((at[first] + lo, h[at[first]], first + lo, last + lo))
    p, h, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = np.append(True, p[1:] != p[:-1])  # an anchor on the border of two parts
    ends = np.append(np.flatnonzero(keep)[1:], len(p)) - 1
    return p[keep], h[keep], first[keep], last[ends]
