"""Identity, value and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.columns import stripped


def digest(*parts: Column) -> Column:
    """First 32 hex digits of the sha256 of the parts, joined by |; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def delivery_key(start: Column, end: Column, raw: Column, label: Column) -> Column:
    """Both ends of the window if there is one ('None' for a missing end), else the text itself."""
    side = lambda d: F.coalesce(d.cast("string"), F.lit("None"))
    text = F.when(F.coalesce(raw, F.lit("")) != "", raw).otherwise(F.coalesce(label, F.lit("")))
    return F.when(start.isNotNull() | end.isNotNull(), F.concat_ws("|", side(start), side(end))).otherwise(F.lower(stripped(text)))


def identity_hash(site: Column, location: Column, grain: Column, grain_raw: Column, key: Column, futures_month: Column) -> Column:
    name = F.when(F.coalesce(grain, F.lit("")) != "", grain).otherwise(grain_raw)
    return digest(site, location, name, key, futures_month)


def four_places(value: Column) -> Column:
    """As printf's %.4f, which rounds the exact binary value; format_number does, format_string doesn't."""
    return F.coalesce(F.regexp_replace(F.format_number(value, 4), ",", ""), F.lit(""))


def value_hash(*values: Column) -> Column:
    return digest(*map(four_places, values))


def content_signature(identity: Column, value: Column) -> Column:
    """An aggregate: the same for the same set of rows in any order."""
    pairs = F.collect_list(F.concat_ws(":", identity, value))
    return F.substring(F.sha2(F.array_join(F.array_sort(pairs), "|"), 256), 1, 32)
