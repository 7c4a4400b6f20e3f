"""Quality classifier: an additive model of binned features and feature pairs, scored by table look-ups."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import id_remainder, map_arrow, table

FEATURES = (
    "log_chars", "mean_word", "longest_word", "capitals", "digits", "exclamations", "symbols", "stops", "commas",
    "high_bytes", "byte_entropy", "words_a_line", "distinct_words", "distinct_pairs", "same_word_runs", "repeated_lines",
)
#: Labelled documents to learn from (smallest hashes of their ids); bounds what comes to the driver.
TRAIN_DOCS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, LEAVES, RATE, RIDGE = 32, 8, 8, 150, 60, 3, 0.15, 1.0


def features(text: str | None) -> list[float]:
    """The text's features in the order of FEATURES; counts are shares, so that long and short texts compare."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n, nw = max(len(data), 1), max(len(words), 1)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = h[h > 0] / n
    upper, lower = int(h[0x41:0x5B].sum()), int(h[0x61:0x7B].sum())
    lines = text.split("\n")
    return [
        float(np.log1p(len(data))),
        float(n - h[[9, 10, 11, 12, 13, 32]].sum()) / nw,
        float(max(map(len, words), default=0)),
        upper / max(upper + lower, 1),
        float(h[0x30:0x3A].sum()) / n,
        float(h[0x21]) / nw,
        float(h[[0x23, 0x2A, 0x24, 0x25, 0x26, 0x7C, 0x3C, 0x3E]].sum()) / nw,
        float(h[0x2E]) / nw,
        float(h[0x2C]) / nw,
        float(h[0x80:].sum()) / n,
        float(-(p * np.log2(p)).sum()),
        len(words) / len(lines),
        len(set(words)) / nw,
        len(set(zip(words, words[1:]))) / nw,
        sum(map(eq, words, words[1:])) / nw,
        1 - len(set(lines)) / len(lines),
    ]


@dataclass
class Gam:
    """edges: bin borders of each feature. tables: a value for each bin. pairs: features i, j and a value for each pair of coarse bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: table values are added up for all rows at once."""
        total = np.full(len(x), self.base)
        for t, b in zip(self.tables, self.bins(x, self.edges), strict=True):
            total += t[b]
        coarse = self.bins(x, self.coarse)
        for i, j, t in self.pairs:
            total += t[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Bin values of a tree that cuts the bins into at most `leaves` ranges; g, h: sums of gradients and hessians by bin."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(m[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a plane of bins into four, its gain and its values."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    rows, cols = g.shape
    best, at = -1.0, (1, 1)
    i, j = np.meshgrid(np.arange(1, rows), np.arange(1, cols), indexing="ij")

    def part(c, a, b, d, e):
        return c[b, e] - c[a, e] - c[b, d] + c[a, d]

    zero, r, c = np.zeros_like(i), np.full_like(i, rows), np.full_like(i, cols)
    corners = ((zero, i, zero, j), (zero, i, j, c), (i, r, zero, j), (i, r, j, c))
    gain = sum(part(cg, *q) ** 2 / (part(ch, *q) + RIDGE) for q in corners) - cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    if gain.size:
        k = np.unravel_index(int(np.argmax(gain)), gain.shape)
        best, at = float(gain[k]), (int(i[k]), int(j[k]))
    out = np.zeros(g.shape)
    for a, b, d, e in ((0, at[0], 0, at[1]), (0, at[0], at[1], cols), (at[0], rows, 0, at[1]), (at[0], rows, at[1], cols)):
        out[a:b, d:e] = part(cg, a, b, d, e) / (part(ch, a, b, d, e) + RIDGE)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting: each round adds a shallow tree for one feature after the other, then for the strongest pairs."""
    k = x.shape[1]
    prior = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.array([]) for f in range(k)]
    coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(x) else np.array([]) for f in range(k)]
    model = Gam(float(np.log(prior / (1 - prior))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, [])
    if len(np.unique(y)) < 2:
        return model
    total = np.full(len(y), model.base)
    bins = model.bins(x, edges)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(k):
            g, h = slopes()
            size = len(model.tables[f])
            step = RATE * _shallow_tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size), LEAVES)
            model.tables[f] += step
            total += step[bins[f]]
    rough = model.bins(x, coarse)
    shape = [len(e) + 1 for e in coarse]
    flat = {(i, j): rough[i] * shape[j] + rough[j] for i, j in combinations(range(k), 2) if shape[i] > 1 and shape[j] > 1}

    def plane(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(flat[i, j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = slopes()
    chosen = sorted(flat, key=lambda p: -_quadrants(plane(*p, g), plane(*p, h))[0])[:PAIRS]
    values = {p: np.zeros((shape[p[0]], shape[p[1]])) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for p in chosen:
            g, h = slopes()
            step = RATE * _quadrants(plane(*p, g), plane(*p, h))[1]
            values[p] += step
            total += step.ravel()[flat[p]]
    model.pairs = [(i, j, values[i, j]) for i, j in chosen]
    return model


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """From at most TRAIN_DOCS labelled documents whose id's remainder is not 1: their features alone come to the driver.

    Labels that are null or have no id don't count; of several labels of one id the largest does, and of several texts the
    least, so an id is one row whatever repeats. Without a label of each kind all texts get the share of label 1.
    """
    rows = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (id_remainder(F.col(id_col), 3) != 1))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(TRAIN_DOCS)
    )
    # bounded by TRAIN_DOCS rows of an id and a label, so it can go to every executor
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id")
    texts = texts.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))

    def make():
        def run(batch) -> dict:
            x = [features(t) for t in batch.column("text").to_pylist()]
            return {"id": batch.column("id").to_pylist(), "y": batch.column("y").to_pylist(), "x": x}

        return run

    seen = map_arrow(texts, make, "id bigint, y double, x array<double>").collect()
    seen.sort(key=lambda r: (r.id, r.x))
    return fit(np.array([r.x for r in seen]).reshape(len(seen), len(FEATURES)), np.array([r.y for r in seen]))


def score_quality(docs: DataFrame, model: Gam, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted. Texts are read whole, in place, without a shuffle.

    Null and empty texts get the score of their (zero) features. A null id counts as the empty text for held_out;
    repeated rows get equal rows; other columns are ignored.
    """

    def make():
        def run(batch) -> dict:
            texts = batch.column("text").to_pylist()
            x = np.array([features(t) for t in texts])
            return {"id": batch.column("id").to_pylist(), "score": model.score(x)}

        return run

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, make, "id bigint, score double").select(
        F.col("id").alias(id_col),
        (id_remainder(F.col("id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
