"""The induced sort against sorted suffixes, and the repeats that it finds against plain Python."""

import random

import numpy as np
import pytest

from millrace.llm import induced_sort
from tests.llm.conftest import prose


@pytest.mark.parametrize("held", [1 << 18, 8])
def test_order_and_common_prefixes(held):
    rng = random.Random(4)
    texts = [[0], [1, 0], [1, 1, 1, 0], [2, 1, 2, 1, 2, 1, 0]] + [[*(rng.randrange(1, top) for _ in range(rng.randrange(1, 120))), 0] for top in (2, 3, 5, 200) for _ in range(40)]
    for t in texts:
        want = sorted(range(len(t)), key=lambda i: t[i:])
        got = induced_sort.suffix_order(np.array(t, np.int64), 7, held)
        assert [p for p, _ in got] == want
        shared = [0] + [next((k for k in range(7) if t[a + k : a + k + 1] != t[b + k : b + k + 1]), 7) for a, b in zip(want, want[1:], strict=False)]
        assert [n for _, n in got] == shared, t


def test_repeats_on_disk_runs():
    rng = random.Random(5)
    shared = prose(rng, 60).encode()
    docs = [prose(rng, 30).encode(), b"", shared, prose(rng, 20).encode() + shared[7:300], b"ab" * 150, shared * 2]
    data, seen, want = b"".join(docs), set(), []
    for k, d in enumerate(docs):
        at = len(b"".join(docs[:k]))
        for p in range(len(d) - 99):
            if d[p : p + 100] in seen:
                want.append(at + p)
            seen.add(d[p : p + 100])
    before = induced_sort.DiskQueue.written
    assert induced_sort.repeated_starts(docs, held=500).tolist() == want and len(want) > 300 and len(data) > 1000
    assert induced_sort.DiskQueue.written > before
