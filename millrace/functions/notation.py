"""Trade notation as column expressions: prices, basis, changes, futures months, names of grains.

All prices are dollars a bushel. Nothing raises: what can't be read is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.columns import bound, no_notes, stripped
from millrace.vocabulary import COMMODITY_ALIASES, EIGHTHS_PARTS, GRADE, MONTHS, MONTH_CODES, MONTH_WORD, NUMBER

_NAMED_MONTH = r"(?i)\b" + MONTH_WORD + r"[a-z]*\.?\s*'?(\d{2,4})\b"
_SYMBOL = rf"(?i)^@?([A-Z]{{1,3}})\s?([{MONTH_CODES}])(\d{{1,2}})$"


def _bare(raw: Column) -> Column:
    return stripped(F.translate(F.coalesce(raw, F.lit("")), "$,", ""))


def _says(text: Column, *words: str) -> Column:
    """Whether a text without blanks at its ends is one of these words in any case."""
    return F.regexp_like(text, F.lit("(?i)^(?:" + "|".join(map(re.escape, words)) + r")\z"))


def eighths(text: Column) -> Column:
    """423-4 is 423 and four eighths of a cent."""
    part = lambda k: F.regexp_extract(text, EIGHTHS_PARTS, k)
    value = (part(2).try_cast("double") + part(3).try_cast("double") / 8) / 100
    return F.when(F.regexp_like(text, F.lit(EIGHTHS_PARTS)), F.when(part(1) == "-", -value).otherwise(value))


def _read(text: Column, then: Callable[[Column, Column, Column], Column]) -> Column:
    """then(text, value in eighths, digits of the first number): each is looked for once; no number is the empty string."""
    found = F.struct(text.alias("text"), eighths(text).alias("eighth"), F.regexp_extract(text, NUMBER, 0).alias("digits"))
    return bound(found, lambda x: then(x["text"], x["eighth"], x["digits"]))


def _result(value: Column, note_list: Column) -> Column:
    return F.struct((value + F.lit(0.0)).alias("value"), note_list.alias("notes"))


#: A number with a point and nothing else: no eighths, no words, nothing to be taken off.
_DECIMAL = r"^[-+]?\d{0,4}\.\d{1,6}\z"


def _if_decimal(raw: Column, then: Callable[[Column], Column], other: Column) -> Column:
    """then(number) of a text that is just a decimal number, as most are; else what its whole reading gives."""
    return F.when(F.regexp_like(raw, F.lit(_DECIMAL)), bound(raw.try_cast("double"), then)).otherwise(other)


def price(raw: Column) -> Column:
    """struct<value, notes>: dollars, cents above 50, or eighths; 'n/a', 'closed' and the like are null."""

    def decimal(x: Column) -> Column:
        cents = F.abs(x) > 50
        return _result(F.round(F.when(cents, x / 100).otherwise(x), 6), F.when(cents, F.array(F.lit("unit_assumed_cents"))).otherwise(no_notes()))

    return _if_decimal(raw, decimal, bound(_bare(raw), lambda text: _read(text, _price)))


def _price(text: Column, eighth: Column, digits: Column) -> Column:
    none = (text == "") | _says(text, "n/a", "na", "-", "closed", "call")
    number = digits.try_cast("double")
    cents = eighth.isNull() & (F.abs(number) > 50)
    value = F.when(none, None).when(eighth.isNotNull(), eighth).when(cents, number / 100).otherwise(number)
    return _result(F.round(value, 6), F.when(~none & cents, F.array(F.lit("unit_assumed_cents"))).otherwise(no_notes()))


def basis(raw: Column) -> Column:
    """struct<value, notes>: whole numbers from 3 on are cents; beyond five dollars either way it can't be a basis."""

    def decimal(x: Column) -> Column:
        far = F.abs(x) > 5
        return _result(F.round(F.when(~far, x), 6), F.when(far, F.array(F.lit("basis_out_of_range"))).otherwise(no_notes()))

    return _if_decimal(raw, decimal, bound(_bare(raw), lambda text: _read(text, _basis)))


def _basis(text: Column, eighth: Column, digits: Column) -> Column:
    none = (text == "") | _says(text, "n/a", "na", "-")
    number = digits.try_cast("double")
    cents = eighth.isNull() & ~digits.contains(".") & (F.abs(number) >= 3)
    value = F.when(none, None).when(eighth.isNotNull(), eighth).when(cents, number / 100).otherwise(number)

    def checked(x: Column) -> Column:
        far = F.coalesce(x["eighth"].isNull() & (F.abs(x["value"]) > 5), F.lit(False))
        listed = F.concat(F.when(x["cents"], F.array(F.lit("unit_assumed_cents"))).otherwise(no_notes()), F.when(far, F.array(F.lit("basis_out_of_range"))).otherwise(no_notes()))
        return _result(F.round(F.when(~far, x["value"]), 6), listed)

    return bound(F.struct(eighth.alias("eighth"), value.alias("value"), F.coalesce(~none & cents, F.lit(False)).alias("cents")), checked)


def change(raw: Column) -> Column:
    """Null if there is none, 0 if unchanged."""
    return _if_decimal(raw, lambda x: F.round(x, 6) + F.lit(0.0), bound(stripped(raw), lambda text: _read(text, _change)))


def _change(text: Column, eighth: Column, digits: Column) -> Column:
    still = _says(text, "unch", "uc", "nc", "-", "0", "0.00")
    value = F.when(text == "", None).when(still, 0.0).when(eighth.isNotNull(), eighth).otherwise(digits.try_cast("double"))
    return F.round(value, 6) + F.lit(0.0)


def pivot_year(yy: Column) -> Column:
    return F.when(yy < 80, yy + 2000).otherwise(yy + 1900)


def month_number(word: Column) -> Column:
    """1 to 12 for a month's name or usual short form in any case."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), F.lower(word))


def futures_month(raw: Column, ref: Column) -> Column:
    """'YYYY-MM' from a name with a year or a contract symbol. A one-digit year is in the reference date's decade, or the next."""
    return bound(stripped(raw), lambda text: F.when(text != "", _futures_month(text, ref)))


def _futures_month(text: Column, ref: Column) -> Column:
    named = F.struct(F.regexp_extract(text, _NAMED_MONTH, 2).try_cast("int").alias("year"), F.regexp_extract(text, _NAMED_MONTH, 1).alias("month"))

    def by_name(x: Column) -> Column:
        full = F.when(x["year"] > 100, x["year"]).otherwise(pivot_year(x["year"]))
        return F.when(x["year"].isNotNull(), F.format_string("%04d-%02d", full, month_number(x["month"])))

    def by_symbol(compact: Column) -> Column:
        parts = F.struct(F.regexp_extract(compact, _SYMBOL, 3).try_cast("int").alias("yy"), F.regexp_extract(compact, _SYMBOL, 2).alias("code"))

        def told(x: Column) -> Column:
            near = (F.floor(F.year(ref) / 10) * 10).cast("int") + x["yy"]
            year = F.when(x["yy"] < 10, F.when(near < F.year(ref) - 1, near + 10).otherwise(near)).otherwise(pivot_year(x["yy"]))
            return F.when(x["yy"].isNotNull(), F.format_string("%04d-%02d", year, F.instr(F.lit(MONTH_CODES), x["code"])))

        return bound(parts, told)

    return F.coalesce(bound(named, by_name), bound(F.upper(F.replace(text, F.lit(" "), F.lit(""))), by_symbol))


def _by_length() -> list[tuple[str, str]]:
    pairs = [(alias, name) for name, aliases in COMMODITY_ALIASES.items() for alias in aliases]
    return sorted(pairs, key=lambda p: len(p[0]), reverse=True)


def grain(raw: Column) -> Column:
    """The grain named in a text: the longest alias that stands in it as words, after a grade at its start."""
    text = stripped(F.regexp_replace(F.lower(stripped(raw)), GRADE, ""))
    pairs = [(rf"\b{re.escape(alias)}\b".replace("\\ ", " "), name) for alias, name in _by_length()]

    def named(t: Column) -> Column:
        """The pattern is only tried where the alias stands in the text at all."""
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for (alias, _), (pattern, name) in zip(_by_length(), pairs, strict=True):
            out = out.when(t.contains(alias) & F.regexp_like(t, F.lit(pattern)), name)
        return out

    return bound(text, named)
