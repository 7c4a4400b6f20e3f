"""Suffix order and common prefixes of a shard by external induced sorting: the method that op10 was dealt, as measured.

Suffix tuples go through queues whose runs lie on disk. Substrings between the places where a text turns from falling to
rising are sorted and named, and ordered by recursion; from them the order of all falling suffixes, and from these that of
all rising ones, is induced by a queue that gives the least tuple (symbol, when it was put, place, common prefix). Common
prefixes, up to a bound, are carried along: what two neighbours share is one more than the least that neighbours shared
between the suffixes that they were induced from.

The result is exact, and queues hold a bounded number of tuples in memory; but each byte of a text goes through them as a
tuple of Python. The README has the figures of that; op10_suffix_dedup uses anchors (see suffix_dedup) instead.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

WIDTH = 100
#: Tuples that a queue holds in memory; of more, the larger half goes to disk as a sorted run.
HELD = 1 << 18


class DiskQueue:
    """A priority queue of tuples; written counts the bytes that went to disk."""

    written = 0

    def __init__(self, held: int = HELD):
        self.held, self.near, self.runs, self.made = held, [], [], 0

    def put(self, row: tuple) -> None:
        heapq.heappush(self.near, row)
        if len(self.near) > self.held:
            self.near.sort()
            run = self._run(self.near[self.held // 2 :])
            self.near = self.near[: self.held // 2]
            self.made += 1
            heapq.heappush(self.runs, (next(run), self.made, run))

    def _run(self, rows: list[tuple]) -> Iterator[tuple]:
        with tempfile.TemporaryFile() as f:
            for at in range(0, len(rows), 4096):
                pickle.dump(rows[at : at + 4096], f)
            DiskQueue.written += f.tell()
            f.seek(0)
            for _ in range(0, len(rows), 4096):
                yield from pickle.load(f)

    def __bool__(self) -> bool:
        return bool(self.near or self.runs)

    def least(self) -> tuple:
        if self.near and self.runs:
            return min(self.near[0], self.runs[0][0])
        return self.near[0] if self.near else self.runs[0][0]

    def get(self) -> tuple:
        if self.near and (not self.runs or self.near[0] <= self.runs[0][0]):
            return heapq.heappop(self.near)
        row, number, run = self.runs[0]
        after = next(run, None)
        if after is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (after, number, run))
        return row


class _Least:
    """The least of the values that came after some turn: a stack of those that none after them is under."""

    def __init__(self):
        self.at, self.value = [], []

    def put(self, at: int, value: int) -> None:
        while self.value and self.value[-1] >= value:
            self.value.pop()
            self.at.pop()
        self.at.append(at)
        self.value.append(value)

    def after(self, at: int) -> int:
        return self.value[bisect_left(self.at, at + 1)]


def _rises(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the one after it; equal symbols go with the next that differs, the last one rises."""
    step = np.concatenate((np.sign(np.diff(text)), [1]))
    at = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _shared(text: np.ndarray, a: int, b: int, most: int) -> int:
    n = min(most, len(text) - max(a, b))
    differ = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(differ[0]) if len(differ) else n


def _induced(text: np.ndarray, sources: list[tuple[int, int]], wanted: np.ndarray, sign: int, most: int, held: int) -> list[tuple[int, int]]:
    """Suffixes of the wanted kind, (place, what it shares with the one before), from those of the other kind, in the same order:
    ascending (sign 1), or descending (-1). Of one symbol, the wanted ones come first."""
    queue, waiting, out, least, last = DiskQueue(held), iter(sources), [], _Least(), {}
    source, turn, before = next(waiting, None), 0, None
    while queue or source is not None:
        if queue and (source is None or queue.least()[0] <= sign * int(text[source[0]])):
            _, _, place, shared = queue.get()
            out.append((place, shared))
            kind = True
        else:
            (place, shared), source, kind = source, next(waiting, None), False
            if before is not None and before[1]:  # the one before is of the other kind: they may have a symbol in common
                shared = _shared(text, before[0], place, most)
        least.put(turn, shared)
        before = place, kind
        if place and wanted[place - 1]:
            c = int(text[place - 1])
            both = min(most, 1 + least.after(last[c])) if c in last else 0
            last[c] = turn
            queue.put((sign * c, turn, place - 1, both))
        turn += 1
    return out


def suffix_order(text: np.ndarray, most: int = WIDTH, held: int = HELD) -> list[tuple[int, int]]:
    """(place, symbols shared with the one before, up to `most`) of all suffixes in order. The last symbol of `text` must be
    its least and be there once."""
    rises = _rises(text)
    turns = np.flatnonzero(rises[1:] & ~rises[:-1]) + 1
    kinds = (text.astype(np.int64) * 2 + rises).astype(">i8")
    queue = DiskQueue(held)
    for k, p in enumerate(turns.tolist()):
        queue.put((kinds[p : (turns[k + 1] if k + 1 < len(turns) else p) + 1].tobytes(), k))
    names, name, before, order = np.zeros(len(turns), np.int64), -1, None, []
    while queue:
        key, k = queue.get()
        name, before = name + (key != before), key
        names[k] = name
        order.append(k)
    if name + 1 < len(turns):
        order = [k for k, _ in suffix_order(names, 0, held)]
    seeds, before = [], None
    for p in turns[order].tolist():
        seeds.append((p, 0 if before is None or not most else _shared(text, before, p, most)))
        before = p
    falling = _induced(text, seeds, ~rises, 1, most, held)
    back = [(p, falling[k + 1][1] if k + 1 < len(falling) else 0) for k, (p, _) in enumerate(falling)][::-1]
    rising = _induced(text, back, rises, -1, most, held)[::-1]
    up = [(len(text) - 1, 0), *((p, rising[k - 1][1] if k else 0) for k, (p, _) in enumerate(rising))]
    out, i, j, before = [], 0, 0, None
    while i < len(falling) or j < len(up):
        kind = j == len(up) or (i < len(falling) and text[falling[i][0]] <= text[up[j][0]])
        place, shared = falling[i] if kind else up[j]
        i, j = i + kind, j + (not kind)
        if before is not None and before[1] != kind:
            shared = _shared(text, before[0], place, most)
        out.append((place, shared))
        before = place, kind
    return out


def repeated_starts(docs: list[bytes], width: int = WIDTH, held: int = HELD) -> np.ndarray:
    """Starts, in the documents put together, of strings of `width` bytes that also start earlier and cross no document."""
    ends = np.cumsum([len(d) + 1 for d in docs])
    text = np.concatenate([*(np.concatenate((np.frombuffer(d, np.uint8).astype(np.int64) + 2, [1])) for d in docs), [0]])
    owner = np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
    found, group = [], []

    def close() -> None:
        keep = min(group)
        if ends[owner[keep]] - 1 - keep >= width:
            found.extend(p for p in group if p != keep)

    for place, shared in suffix_order(text, width, held):
        if shared < width and group:
            if len(group) > 1:
                close()
            group = []
        group.append(place)
    if len(group) > 1:
        close()
    starts = np.sort(np.array(found, np.int64))
    return starts - owner[starts]  # without the marks between documents
