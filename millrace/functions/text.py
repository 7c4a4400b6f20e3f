"""URLs, domains, vendors and page texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.columns import contains_any, first_match, stripped
from millrace.vocabulary import CHALLENGE_MARKS, NOTE_TEXTS, PROBE_WORDS, SCRIPTED_VENDORS, VENDOR_MARKS

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(first_match(url, _HOST, 1), F.lit(""))


def path(url: Column) -> Column:
    """Lower-cased path of an absolute or relative URL."""
    absolute = F.regexp_like(url, F.lit(_HOST))
    return F.lower(F.when(absolute, F.regexp_extract(url, _PATH, 1)).otherwise(F.regexp_extract(url, "^([^?#]*)", 1)))


def registered_domain(netloc: Column, *, strip_letters: bool = True) -> Column:
    """The last two labels. With `strip_letters` all w's and dots at the start go, else only a leading 'www.'."""
    low = F.lower(netloc)
    name = F.regexp_extract(F.regexp_replace(low, "^[w.]+" if strip_letters else r"^www\.", ""), "^([^:]*)", 1)
    labels = F.split(name, r"\.")
    short = low if strip_letters else name
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(short)


def normalized_url(raw: Column) -> Column:
    """With a scheme; null without a host that has a dot."""
    text = stripped(raw)
    url = F.when(F.regexp_like(text, F.lit("(?i)^https?://")), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when((text != "") & host(url).contains("."), url)


def comparable_url(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", ""))


def vendor(html: Column) -> Column:
    """Who made the page's table; marks are looked for in this order."""
    low = F.lower(html)
    out = F.lit("unknown")
    for name, marks in reversed(VENDOR_MARKS.items()):
        out = F.when(contains_any(low, marks), name).otherwise(out)
    return out


def needs_render(html: Column, score: Column, n_rows: Column) -> Column:
    """Whether a page must be fetched with a browser: scripted vendors without rows, challenges, or script shells."""
    low = F.lower(html)
    empty = n_rows == 0
    scripts = F.regexp_count(html, F.lit("<script"))
    shell = (score < 8) & empty & (low.contains("<noscript") | ((scripts > 15) & (F.length(html) < 60_000)))
    return (vendor(html).isin(SCRIPTED_VENDORS) & empty) | contains_any(low, CHALLENGE_MARKS) | shell


def grains_mentioned(text: Column) -> Column:
    low = F.lower(text)
    named = F.array(*(F.when(low.contains(w), F.lit(name)) for w, name in PROBE_WORDS.items()))
    return F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))


def price_hits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\b\d{1,2}\.\d{2,4}\b"))


def basis_hits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[+-]\s?\d{0,2}\.\d{2,4}\b"))


def looks_like_bid_page(url: Column, text: Column, head: Column) -> Column:
    """Grains count in the whole text, prices and basis in its head."""
    says = contains_any(path(url), ["cashbid", "cash-bid", "bid"])
    return ((F.size(grains_mentioned(text)) > 0) & ((price_hits(head) >= 3) | (basis_hits(head) >= 2))) | (says & (price_hits(head) >= 3))


def notes_text(names: Column) -> Column:
    """Notes in words; unknown ones are left out, none at all is null."""
    known = F.create_map(*[F.lit(x) for kv in NOTE_TEXTS.items() for x in kv])
    told = F.filter(F.transform(names, lambda n: F.element_at(known, n)), lambda t: t.isNotNull())
    return F.when(F.size(told) > 0, F.array_join(told, "; "))


def search_target(href: Column) -> Column:
    """Where a search engine's redirect leads: DuckDuckGo's uddg parameter, Bing's base64 u parameter, or the link itself."""
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    ddg = first_match(full, r"[?&]uddg=([^&#]+)", 1)
    code = first_match(full, r"[?&]u=a1([^&#]+)", 1)
    standard = F.translate(code, "-_", "+/")
    padded = F.rpad(standard, (F.ceil(F.length(standard) / 4) * 4).cast("int"), "=")
    bing = F.try_to_binary(padded, F.lit("base64")).cast("string")
    is_ddg = host(full).contains("duckduckgo.com") & path(full).startswith("/l/")
    is_bing = host(full).contains("bing.com") & path(full).startswith("/ck/a")
    direct = F.when(F.regexp_like(full, F.lit("^https?://")), full)
    return F.when(is_ddg, F.url_decode(ddg)).when(is_bing, F.when(bing.startswith("http"), bing)).otherwise(direct)
