"""numpy parts of the near-duplicate search: weighted shingles, consistent weighted samples, weighted Jaccard similarity."""

from __future__ import annotations

import numpy as np

from millrace.llm.common import WORD_TABLE
from millrace.llm.repeats import Hashed, mixed

SHINGLE = 5
HASHES, ROWS = 64, 4
#: Entries of the table in which shingles are counted first, by hash; it only says which of them may be frequent.
DF_BITS = 20
#: A shingle in more than one of so many documents is frequent, and its documents are counted exactly. How many are
#: frequent is bounded by the shingles of a mean document times this number, whatever the input.
FREQUENT = 1000
#: idf lies between 1 (in every document) and 1 + IDF_RANGE (in one of FREQUENT or fewer).
IDF_RANGE = 0.25
PIECE = 1 << 20
_PARAM_BITS = 16
_COLUMNS = 1024


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each blank-separated word, in order; long texts are cut at blanks, so memory stays bounded."""
    found = []
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            end = cut if cut > at else (data.find(b" ", end) + 1 or len(data) + 1) - 1
        part = np.frombuffer(data[at:end], np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], part != 0x20, [False])).view(np.int8)))
        start, stop = edge[::2], edge[1::2]
        found.append(mixed(Hashed(part).of(start, stop) + (stop - start).astype(np.uint64)))
        at = max(end, at + 1)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """A hash of each run of five words; fewer words, but not none, are one shingle. Words as in WORD_TABLE."""
    w = word_hashes(text.encode().translate(WORD_TABLE)) if text else np.zeros(0, np.uint64)
    n = min(SHINGLE, len(w))
    if n == 0:
        return w
    total = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xA24BAED4963EE407) + w[k : k + len(total)]
    return mixed(total)


def entries(h: np.ndarray, bits: int = DF_BITS) -> np.ndarray:
    """Places of shingles in the table in which they are counted first."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def idf_values(df: np.ndarray, n_docs: int) -> np.ndarray:
    """idf of frequent shingles by the share of documents that have them, on a scale of logarithms."""
    share = np.maximum(df, 1) / max(n_docs, 1)
    return (1 + IDF_RANGE * np.log(share) / np.log(1 / FREQUENT)).clip(1, 1 + IDF_RANGE).astype(np.float32)


def weighted(text: str | None, idf: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights (1 + ln tf) * idf. idf: frequent shingles, sorted, and their values."""
    h, tf = np.unique(shingles(text), return_counts=True)
    known, value = idf
    rarity = np.full(len(h), 1 + IDF_RANGE, np.float32)
    if len(known):
        at = np.searchsorted(known, h).clip(max=len(known) - 1)
        found = known[at] == h
        rarity[found] = value[at[found]]
    return h, (1 + np.log(tf)).astype(np.float32) * rarity


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater ones; 0 if neither has a shingle."""
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return least / (total - least) if total else 0.0


class Sampler:
    """Improved consistent weighted sampling: for each hash a shingle and a level, equal in two texts with the
    probability of their weighted Jaccard similarity.

    A shingle of weight w gets r, c ~ Gamma(2, 1) and b ~ U(0, 1); t = floor(ln w / r + b), and the shingle with the
    least ln c - r * (t - b + 1) is drawn, with its t. The parameters of a shingle are read from a table of draws, at a
    place that depends on the shingle and the hash.
    """

    def __init__(self, hashes: int = HASHES, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = 1 << _PARAM_BITS
        r, c = rng.gamma(2, 1, n), rng.gamma(2, 1, n)
        b = rng.random(n)
        # 128 makes all values positive, and positive floats are ordered as their bits
        floats = (1 / r, b, np.log(c) - r + r * b + 128, r)
        self.tables = [x.astype(np.float32) for x in floats]
        self.odd = (rng.integers(1, 1 << 63, hashes, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        self.hashes = hashes

    def _level(self, h: np.ndarray, lw: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """t, and the value that the drawn shingle has the least of."""
        place = h * odd
        place >>= np.uint64(64 - _PARAM_BITS)
        read = [x.take(place.view(np.int64), mode="clip") for x in self.tables]  # places are in range
        t = read[0]
        t *= lw
        t += read[1]
        np.floor(t, out=t)
        return t, read[2] - read[3] * t

    def signatures(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """uint64 samples [set, hash]; sets must not be empty."""
        sizes = np.array([len(h) for h, _ in sets])
        h = np.concatenate([x for x, _ in sets])
        lw = np.log(np.concatenate([w for _, w in sets]))
        home = np.repeat(np.arange(len(sets)), sizes)
        least = np.full((len(sets), self.hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
        for a in range(0, len(h), _COLUMNS):
            hh, ww, dd = h[a : a + _COLUMNS], lw[a : a + _COLUMNS], home[a : a + _COLUMNS]
            _, v = self._level(hh[None, :], ww[None, :], self.odd[:, None])
            key = v.view(np.uint32).astype(np.uint64)
            key <<= np.uint64(32)
            key |= np.arange(a, a + len(hh), dtype=np.uint64)
            first = np.flatnonzero(np.concatenate(([True], dd[1:] != dd[:-1])))
            low = np.minimum.reduceat(key, first, axis=1).T
            least[dd[first]] = np.minimum(least[dd[first]], low)
        won = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        t, _ = self._level(h[won], lw[won], self.odd[None, :])
        return mixed(h[won] ^ mixed(t.astype(np.int64).view(np.uint64)))


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each run of `rows` samples and its place [set, band]."""
    n, k = sig.shape
    parts = sig.reshape(n, k // rows, rows)
    total = np.broadcast_to(np.arange(k // rows, dtype=np.uint64), (n, k // rows)).copy()
    for j in range(rows):
        total = mixed(total * np.uint64(0xA24BAED4963EE407) + parts[:, :, j])
    return total
