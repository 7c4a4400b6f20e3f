"""numpy parts of the repeat removal: content-defined anchors, hashes of windows, runs of bytes."""

from __future__ import annotations

import numpy as np

#: Bytes of a string that counts as repeated, and of the grams among which anchors are chosen.
WIDTH, GRAM = 100, 24
#: Gram starts within a string: each string of WIDTH bytes holds the least of these.
REACH = WIDTH - GRAM + 1
#: Window starts worked on at once; also what fits below the hash in a sort key.
SEGMENT = (1 << 18) - 4 * WIDTH
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 18) + 1
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """All bits of each number depend on all."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashed:
    """Polynomial hashes modulo 2^64 of all substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups of window starts with one anchor: first start, number of starts, gram hash, hash of all bytes they cover.

    data: documents one after the other, ends: where each ends. The anchor of the string at p is the gram in it with the
    least hash (the leftmost, if several); it depends on the string alone, so equal strings have their anchor at the
    same place. Starts with one anchor are next to each other; if all bytes that they cover are equal, so are all their
    strings, in order.
    """
    found = []
    for at in range(0, len(data), SEGMENT):
        part = data[at : at + SEGMENT + 2 * WIDTH]
        n = min(SEGMENT, len(part) - WIDTH + 1)
        if n <= 0:
            break
        hashed = Hashed(part)
        grams = mixed(hashed.every(GRAM))
        key = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= REACH:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[: n], key[REACH - width : REACH - width + n])
        place = (key & np.uint64(0xFFFFF)).astype(np.int64)
        starts = np.arange(at, at + n)
        valid = ends[np.searchsorted(ends, starts, side="right")] - starts >= WIDTH  # bytes to the end of the document
        # starts of one document with one anchor stand together; an anchor lies in its document
        first = np.flatnonzero(valid & np.concatenate(([True], (place[1:] != place[:-1]) | ~valid[:-1])))
        last = np.flatnonzero(valid & np.concatenate(((place[1:] != place[:-1]) | ~valid[1:], [True])))
        cover = mixed(hashed.of(first, last + WIDTH) ^ mixed((last - first).astype(np.uint64) << np.uint64(8) | (place[first] - first).astype(np.uint64)))
        found.append((first + at, last - first + 1, grams[place[first]], cover))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def covered(starts: np.ndarray, counts: np.ndarray, n: int, width: int = WIDTH) -> np.ndarray:
    """Which of n bytes lie in a string of `width` bytes with its start in one of the runs."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + counts + width - 1, -1)
    return np.cumsum(mark[:-1]) > 0
