"""Quality rules as a short-circuit cascade, ordered by what a sample says about rejections and cost."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from operator import ne

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = bytes(range(0x41, 0x5B))
REPEAT_WINDOW = 5
#: Documents on which the rules are measured, in the mean.
SAMPLE_DOCS = 1000


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words in windows of `width` words that stand in the list twice or more, the first of them included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal pairs get equal numbers, below the count of distinct pairs, so that no product overflows."""
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    pairs = paired(ids[:-1], ids[1:])
    if int(pairs.max()) + 1 == len(pairs):  # no two words stand together twice
        return 0
    fours = paired(pairs[:-2], pairs[2:])
    fives = paired(fours[:-1], ids[4:])
    twice = np.bincount(fives)[fives] > 1
    mark = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + width, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


class Measured:
    """A text and what rules ask of it. What every document's row holds is worked out at once; what a rule alone asks for,
    when that rule is tried."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode()
        self.words = self.data.split()
        self.n_words = len(self.words)
        self.word_chars = len(self.text) - sum(map(self.text.count, BLANKS))
        self.n_symbols = sum(map(self.text.count, SYMBOLS))
        lines = [x for x in self.text.split("\n") if x.strip(BLANKS)]
        self.n_lines, self.n_dup_lines = len(lines), len(lines) - len(set(lines))
        self.n_repeat_words = repeated_words(self.words)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measured], bool]


#: Each rejects by itself, so their order changes the cost and never the verdict. All are stated in whole numbers.
RULES = (
    Rule("word_length", lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 15 * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > d.n_lines),
    Rule("capitals", lambda d: 2 * (len(d.data) - len(d.data.translate(None, UPPER))) > d.word_chars),
    Rule("exclamations", lambda d: 5 * d.text.count("!") > d.n_words),
    Rule("same_word_runs", lambda d: 5 * (d.n_words - 1 - sum(map(ne, d.words, d.words[1:]))) > d.n_words),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> list[tuple[str, float, float]]:
    """Name, share rejected and mean seconds of each rule over a sample, each rule by itself."""

    def make():
        def run(batch) -> dict:
            found = [d for d in map(Measured, batch.column("text").to_pylist()) if not d.base_failed]
            out: dict = {"rule": [], "n": [], "rejected": [], "s": []}
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                rejected = sum(map(rule.rejects, found))
                out["rule"].append(k)
                out["n"].append(len(found))
                out["rejected"].append(int(rejected))
                out["s"].append(time.perf_counter() - began)
            return out

        return run

    rows = map_arrow(docs.select(F.col(text_col).alias("text")), make, "rule int, n bigint, rejected bigint, s double")
    total = {r.rule: r for r in rows.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("s").alias("s")).collect()}
    return [
        (rule.name, total[k].rejected / max(total[k].n, 1), total[k].s / max(total[k].n, 1)) if k in total else (rule.name, 0.0, 1.0)
        for k, rule in enumerate(rules)
    ]


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[Rule, ...]:
    """The rules in the order of rejections per second, from a sample of all rows that a hash of id and text draws."""
    share = -(-SAMPLE_DOCS * 1_000_000 // max(docs.count(), 1))
    sample = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000)) < share)
    gain = {name: rejected / max(seconds, 1e-9) for name, rejected, seconds in measure(sample, rules, text_col=text_col)}
    return tuple(sorted(rules, key=lambda r: -gain[r.name]))


SCHEMA = (
    "id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, tried bigint"
)


def apply_rules(
    docs: DataFrame, rules: tuple[Rule, ...] | None = None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, kept, and tried (how many rules the cascade ran).

    The base counts are for every document; the cascade then stops at the first rule that rejects. `rules` fixes an
    order; else a sample gives it. Every text is read whole, in place, without a shuffle.

    Null or empty text: no words, so base_failed; very long texts are read whole. A null id stays null, repeated rows get equal rows, other columns are
    ignored; an empty table gives no rows.
    """
    order = cascade(docs, id_col=id_col, text_col=text_col) if rules is None else rules

    def make():
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

        def run(batch) -> dict:
            out: dict = {"id": batch.column("id").to_pylist(), "kept": [], "tried": [], **{n: [] for n in names}}
            for text in batch.column("text").to_pylist():
                d = Measured(text)
                for n in names:
                    out[n].append(getattr(d, n))
                tried, kept = 0, not d.base_failed
                if kept:
                    for rule in order:
                        tried += 1
                        if rule.rejects(d):
                            kept = False
                            break
                out["kept"].append(kept)
                out["tried"].append(tried)
            return out

        return run

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, make, SCHEMA).withColumnRenamed("id", id_col)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).drop("tried")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS five FROM g),
r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
m AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS at FROM r, (SELECT unnest(range(5)) AS j)) GROUP BY doc_id),
b AS (SELECT doc_id, t, ws, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls) AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN m USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_dup_lines > n_lines OR 2 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > word_chars
            OR 5 * length(regexp_replace(t, '[^!]', '', 'g')) > n_words
            OR 5 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i-1])) > n_words) AS kept
FROM f
"""
