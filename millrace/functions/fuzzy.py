"""Similarity of short texts by the longest common subsequence, and the column role of a header text."""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import nlargest

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from millrace.vocabulary import HEADER_SYNONYMS


@lru_cache(maxsize=4096)
def _places(text: str) -> dict[str, int]:
    """The places of each character, as bits."""
    bits: dict[str, int] = {}
    for k, c in enumerate(text):
        bits[c] = bits.get(c, 0) | 1 << k
    return bits


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence: a row of its table as the bits of one number, a step per character of b."""
    places, full = _places(a), (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str, least: float = 0.0) -> float:
    """100 * twice the longest common subsequence over both lengths; 0 if the lengths alone keep it below `least`."""
    both = len(a) + len(b)
    if not both:
        return 100.0
    if 200.0 * min(len(a), len(b)) / both < least:
        return 0.0
    return 200.0 * _common(a, b) / both


@lru_cache(maxsize=4096)
def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def token_set_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The words that both have against those that one has: 100 if one's words are all in the other. Below `least`, any value below it."""
    left, right = _words(a), _words(b)
    if not left or not right:
        return 0.0
    shared = left & right
    if shared and (shared == left or shared == right):
        return 100.0
    both, only_left, only_right = (" ".join(sorted(x)) for x in (shared, left - right, right - left))
    first, second = (f"{both} {x}".strip() for x in (only_left, only_right))
    if not both:
        return indel(first, second, least)
    return max(indel(first, second, least), indel(both, first, least), indel(both, second, least))


def partial_ratio(a: str, b: str) -> float:
    """The best indel similarity of the shorter text with a stretch of the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    for stretch in {long[max(0, i) : i + n] for i in range(1 - n, len(long))}:
        best = max(best, indel(short, stretch, best))
    return best


#: All synonyms with their roles, in order.
_SYNONYMS = [(synonym, role) for role, synonyms in HEADER_SYNONYMS.items() for synonym in synonyms]


@lru_cache(maxsize=100_000)
def header_role(header: str) -> str | None:
    """The role of the synonym that is most alike: at 90 or more, or at 80 with a lead of 8 over the next synonym. Of equals
    the first counts. Synonyms below 72 neither win nor come within 8 of one that does."""
    text = re.sub(r"[^a-z0-9 /+.-]", "", header.strip().lower()).strip()
    scores = [token_set_ratio(text, synonym, 72.0) for synonym, _ in _SYNONYMS] if text else [0.0, 0.0]
    best, second = nlargest(2, scores)
    sure = best >= 90 or (best >= 80 and best - second >= 8)
    return _SYNONYMS[scores.index(best)][1] if sure else None


@F.pandas_udf(StringType())
def header_role_udf(headers: pd.Series) -> pd.Series:
    return headers.map(header_role, na_action="ignore").astype(object)


@F.pandas_udf(ArrayType(StringType()))
def header_roles_udf(headers: pd.Series) -> pd.Series:
    """The roles of a grid's header texts; null without a header."""
    return headers.map(lambda texts: [None if t is None else header_role(t) for t in texts], na_action="ignore")


@F.pandas_udf(DoubleType())
def token_set_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def partial_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])
