"""A logarithmic family of suffix arrays over fixed-length windows of byte strings.

A batch of strings gets a suffix array of its window starts, ordered by the windows' bytes: ranks of 8-byte words are
doubled to 128 bytes and joined to the full length. Neighbours that agree in a whole window are long matches. A batch is
then merge-scanned against each level: its suffixes' places there, found by bisection, give both the matches and the
merged order. Levels of equal size merge geometrically, so a window is moved a logarithmic number of times.
"""

from __future__ import annotations

import numpy as np


def _words(text: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte word at every place; text ends in padding."""
    return np.ndarray((len(text) - 7,), ">u8", text.tobytes(), 0, (1,))


def _names(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys: equal keys, equal ranks."""
    order = np.argsort(keys)
    own = keys[order]
    rank = np.empty(len(keys), np.uint64)
    rank[order] = np.cumsum(np.append(False, own[1:] != own[:-1]), dtype=np.uint64)
    return rank


class Level:
    """Window starts in the order of their bytes; equal windows occur once."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, ids: np.ndarray, window: int) -> None:
        self.text, self.starts, self.ids, self.window = text, starts, ids, window

    def gather(self, which: np.ndarray, d: int, words: np.ndarray) -> np.ndarray:
        return words[self.starts[which] + d].astype(np.uint64)

    def places(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """Of each suffix of other: how many here are smaller, and whether the next one here is equal."""
        mine, theirs = _words(self.text), _words(other.text)
        n, lo = len(self.starts), np.zeros(len(other.starts), np.int64)
        hi, equal = np.full(len(lo), n, np.int64), np.zeros(len(lo), bool)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less, same, left = np.zeros(len(open_), bool), np.ones(len(open_), bool), np.arange(len(open_))
            for d in [*range(0, self.window - 7, 8), *([self.window - 8] if self.window % 8 else [])]:
                a, b = self.gather(mid[left], d, mine), other.gather(open_[left], d, theirs)
                less[left] = a < b
                go = a == b
                same[left[~go]] = False
                left = left[go]
                if not left.size:
                    break
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            hit = open_[same]
            equal[hit], lo[hit], hi[hit] = True, mid[same], mid[same]
        return lo, equal


class Family:
    """``add(strings, firsts, lasts)`` numbers the windows from firsts to lasts of each string in turn; ``matched`` says which of all occur twice."""

    def __init__(self, window: int) -> None:
        self.window, self.levels, self.flags, self.count = window, [], [], 0

    def add(self, strings: list[bytes], firsts: np.ndarray, lasts: np.ndarray) -> None:
        sizes = lasts - firsts + 1
        total = int(sizes.sum())
        flags = np.zeros(total, bool)
        self.flags.append((self.count, flags))
        if total:
            text = np.frombuffer(b"".join(strings) + bytes(self.window + 8), np.uint8)
            offsets = np.cumsum([0, *map(len, strings[:-1])])
            before = np.cumsum(sizes) - sizes
            starts = np.arange(total) - np.repeat(before - offsets - firsts, sizes)
            order, rank = self._sorted(text, starts)
            twin = rank[1:] == rank[:-1]
            flags[order] = np.append(False, twin) | np.append(twin, False)
            first = order[np.append(True, ~twin)]
            self._insert(Level(text, starts[first], first + self.count, self.window))
        self.count += total

    def _sorted(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts' order by their windows, and the windows' ranks in that order."""
        rank, size = _names(_words(text).astype(np.uint64)), 8
        while size * 2 <= self.window:
            rank = _names(rank[:-size] << np.uint64(32) | rank[size:])
            size *= 2
        keys = rank[starts] << np.uint64(32) | rank[starts + self.window - size]
        order = np.argsort(keys, kind="stable")
        return order, keys[order]

    def _flag(self, ids: np.ndarray) -> None:
        for base, flags in self.flags:
            own = ids[(ids >= base) & (ids < base + len(flags))]
            flags[own - base] = True

    def _insert(self, new: Level) -> None:
        scanned = []
        for old in self.levels:
            at, equal = old.places(new)
            self._flag(new.ids[equal])
            self._flag(old.ids[at[equal]])
            scanned.append((at, equal))
        while self.levels and len(self.levels[-1].starts) <= 2 * len(new.starts):
            old = self.levels.pop()
            new = self._merged(old, new, *(scanned.pop() if len(scanned) else old.places(new)))
            scanned.clear()
        self.levels.append(new)

    def _merged(self, old: Level, new: Level, at: np.ndarray, equal: np.ndarray) -> Level:
        at, keep = at[~equal], ~equal
        to = at + np.arange(len(at))
        starts, ids = (np.empty(len(old.starts) + len(at), np.int64) for _ in range(2))
        rest = np.ones(len(starts), bool)
        rest[to] = False
        starts[to], ids[to] = new.starts[keep] + len(old.text), new.ids[keep]
        starts[rest], ids[rest] = old.starts, old.ids
        return Level(np.concatenate([old.text, new.text]), starts, ids, self.window)

    def matched(self) -> np.ndarray:
        return np.concatenate([f for _, f in self.flags]) if self.flags else np.zeros(0, bool)
