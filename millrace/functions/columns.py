"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks, no-break spaces and the like included.
_BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without blanks at both ends; null becomes the empty string."""
    return F.trim(F.coalesce(c, F.lit("")), F.lit(_BLANKS))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """Null where the pattern isn't found; an optional group that took no part is the empty string."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is worked out once, however often f uses it. It also keeps long expressions out of generated code."""
    return F.transform(F.array(c), f)[0]


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def notes(*pairs: tuple[Column, str]) -> Column:
    """The names whose conditions hold, as array<string>."""
    listed = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in pairs))
    return F.filter(listed, lambda x: x.isNotNull())


def no_notes() -> Column:
    return F.array().cast("array<string>")
