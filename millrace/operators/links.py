"""Finding pages with bids: links of a page, results of a web search, a first look at a page."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions import text as T
from millrace.functions.columns import contains_any
from millrace.functions.fuzzy import partial_udf, token_set_udf
from millrace.sources.html_grids import html_links, html_texts
from millrace.vocabulary import DIRECTORY_DOMAINS, LINK_REASONS, NAME_EVIDENCE, PENALTY_LINK, STRONG_LINK, WEAK_LINK

LEAST_SCORE = 3
#: Characters of a page in which a first look counts prices and basis.
HEAD = 200_000


@F.pandas_udf(StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b: str, h: str) -> str | None:
        try:
            return urljoin(b, h.strip())
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def _hits(c: Column, words: list[str]) -> Column:
    return sum((F.when(c.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def score_links(links: DataFrame) -> DataFrame:
    """score and reasons for links with url, anchor_text and sibling (whether a known bid page has this path but for numbers)."""
    path, text = T.path(F.col("url")), F.lower(F.coalesce("anchor_text", F.lit("")))
    hay = F.concat_ws(" ", path, text)
    strong = contains_any(hay, STRONG_LINK)
    mid = F.regexp_like(hay, F.lit(r"\bbids?\b"))
    weak, bad = _hits(hay, WEAK_LINK), _hits(hay, PENALTY_LINK)
    said = text.contains("cash bid")
    score = (
        F.when(strong, 4).when(mid, 2).otherwise(0) + F.least(weak, F.lit(2)) + F.when(said, 3).otherwise(0)
        + F.when(F.col("sibling"), 5).otherwise(0) - 3 * bad
    )
    told = LINK_REASONS
    reasons = F.array(
        F.when(strong, told["strong"]).when(mid, told["mid"]), F.when(weak > 0, told["weak"]), F.when(said, told["said"]),
        F.when(F.col("sibling"), told["sibling"]), F.when(bad > 0, told["bad"]),
    )
    return links.withColumns({"score": score.cast("double"), "reasons": F.filter(reasons, lambda r: r.isNotNull())})


def with_siblings(links: DataFrame, known: DataFrame, *, key: list[str]) -> DataFrame:
    """Adds `sibling`: a known URL of the same key has an equal path once numbers are replaced, but not the same path."""
    stem = lambda c: F.regexp_replace(c, r"\d+", "#")
    paths = known.select(*key, T.path(F.col("known_url")).alias("known_path")).where("known_path <> ''").distinct()
    paths = paths.withColumn("stem", stem(F.col("known_path")))
    by_stem = paths.groupBy(*key, "stem").agg(F.min("known_path").alias("lo"), F.max("known_path").alias("hi"))
    own = links.withColumns({"path": T.path(F.col("url"))}).withColumn("stem", stem(F.col("path")))
    other = (F.col("lo") != F.col("path")) | (F.col("hi") != F.col("path"))
    return own.join(by_stem, [*key, "stem"], "left").withColumn("sibling", F.coalesce(other, F.lit(False))).drop("lo", "hi", "path", "stem")


def discover(pages: DataFrame, known: DataFrame, *, by: str = "page_id") -> DataFrame:
    """Likely bid pages linked from pages(page_id, url, html): page_id, url, anchor_text, score, reasons, rank.

    known: page_id, known_url; or another column of the pages instead, named by `by`, so that what many pages share is given
    once. Links to other sites, to the page itself and to known pages are left out; of equal targets the one with the best
    score counts, of equal scores the first.
    """
    base = pages.select(*dict.fromkeys(["page_id", by]), F.col("url").alias("base_url"))
    links = html_links(pages).where("trim(href) <> '' AND NOT trim(href) RLIKE '^(mailto:|tel:|javascript:|#)'").join(base, "page_id")
    links = links.withColumn("absolute", _joined("base_url", "href")).where("absolute RLIKE '^https?://'")
    same = T.registered_domain(T.host(F.col("absolute"))) == T.registered_domain(T.host(F.col("base_url")))
    url = F.regexp_replace(F.regexp_replace("absolute", "#.*$", ""), "/+$", "")
    links = links.where(same).withColumn("url", url).where((F.col("url") != "") & (F.col("url") != F.regexp_replace("base_url", "/+$", "")))
    seen = known.select(by, T.comparable_url(F.col("known_url")).alias("same_url")).distinct()
    links = links.withColumn("same_url", F.lower("url")).join(seen, [by, "same_url"], "left_anti")
    scored = score_links(with_siblings(links, known, key=[by]))
    best = Window.partitionBy("page_id", "url").orderBy(F.desc("score"), "nth")
    first = F.min("nth").over(Window.partitionBy("page_id", "url"))
    kept = scored.withColumns({"k": F.row_number().over(best), "first": first}).where((F.col("k") == 1) & (F.col("score") >= LEAST_SCORE))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "first"))
    return kept.select("page_id", "url", "anchor_text", "score", "reasons", rank.alias("rank"))


def probe(pages: DataFrame) -> DataFrame:
    """A first look at pages(page_id, url, html): title, commodities, hits of prices and basis, whether they look like bid pages."""
    texts = html_texts(pages).join(pages.select("page_id", "url"), "page_id")
    low = F.lower("body")
    head = F.substring(low, 1, HEAD)
    return texts.select(
        "page_id", "url", "title", T.grains_mentioned(low).alias("commodities"), T.price_hits(head).alias("price_hits"), T.basis_hits(head).alias("basis_hits"),
        T.looks_like_bid_page(F.col("url"), low, head).alias("looks_like_bid_page"),
    )


def on_list(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows(domain, ..) with `listed`: whether the domain, or one that it is part of, is among listed(domain).

    Each distinct domain stands under its suffixes, one for each label, and meets the list by equality, so that a list of
    any length costs a join.
    """
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = rows.select("domain").where("domain IS NOT NULL").distinct().select("domain", F.explode(suffixes).alias("suffix"))
    hit = parts.join(listed.select(F.lower("domain").alias("suffix")), "suffix", "left_semi").select("domain").distinct().withColumn("hit", F.lit(True))
    return rows.join(hit, "domain", "left").withColumn("listed", F.coalesce("hit", F.lit(False))).drop("hit")


def resolve_names(results: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """Candidates for a company's site from search results(name, nth, url, title, snippet): the best five with points, one
    for each domain; ambiguous if the best has less than three. directories(domain): sites that are no company's own."""
    domain = T.registered_domain(T.host(F.col("url")), strip_letters=False)
    if directories is None:
        directories = results.sparkSession.createDataFrame([(d,) for d in DIRECTORY_DOMAINS], "domain string")
    rows = on_list(results.where("nth <= 10").withColumn("domain", domain), directories)
    words = F.regexp_replace(F.regexp_replace("domain", r"\.[^.]*$", ""), "[^a-z0-9]+", " ")
    rows = rows.withColumns({"alike": token_set_udf(words, F.lower("name")), "titled": partial_udf(F.lower("name"), F.lower("title"))})
    bid = F.regexp_like(F.concat_ws("\n", "title", "snippet"), F.lit(r"(?i)cash\s*bids?|grain\s*prices?|cash\s*grain"))
    straight = contains_any(T.path(F.col("url")), ["cashbid", "cash-bid", "bids", "grain"])
    score = (
        F.when(F.col("alike") >= 85, 4).when(F.col("alike") >= 60, 3).otherwise(0) + F.when(F.col("titled") >= 85, 2).otherwise(0)
        + F.when(bid, 2).otherwise(0) + F.when(straight, 2).otherwise(0)
    )
    told = NAME_EVIDENCE
    evidence = F.array(
        F.when(F.col("alike") >= 60, told["alike"]), F.when(F.col("titled") >= 85, told["titled"]), F.when(bid, told["bid"]), F.when(straight, told["straight"]),
    )
    social = F.array(F.lit(told["listed"]))
    rows = rows.withColumns({
        "score": F.when(F.col("listed"), -5).otherwise(score).cast("double"),
        "evidence": F.when(F.col("listed"), social).otherwise(F.filter(evidence, lambda x: x.isNotNull())),
    })
    best = Window.partitionBy("name", "domain").orderBy(F.desc("score"), "nth")
    first = F.min("nth").over(Window.partitionBy("name", "domain"))
    rows = rows.withColumns({"k": F.row_number().over(best), "first": first}).where("k = 1 AND score > 0")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "first"))).where("rank <= 5")
    top = F.max("score").over(Window.partitionBy("name"))
    return ranked.select("name", "rank", "url", "domain", F.substring("title", 1, 160).alias("title"), F.substring("snippet", 1, 240).alias("snippet"),
                         "score", "evidence", (top < 3).alias("ambiguous"))


def verified_names(candidates: DataFrame, homepages: DataFrame) -> DataFrame:
    """Candidates of resolve_names after a look at the homepages of the best three, homepages(domain, html): three points
    more, evidence, and the page to go on with, where one links to bids. Ranks are given anew."""
    looked = candidates.where("rank <= 3").select("domain").distinct().join(homepages, "domain")
    pages = looked.select(F.xxhash64("domain").alias("page_id"), F.concat(F.lit("https://"), F.col("domain")).alias("url"), "html", "domain")
    best = discover(pages, pages.select("page_id", F.lit(None).cast("string").alias("known_url"))).where("rank = 1")
    found = best.join(pages.select("page_id", "domain"), "page_id").select("domain", F.col("url").alias("suggested_bid_page"))
    rows = candidates.join(found, "domain", "left")
    sure = F.col("suggested_bid_page").isNotNull() & (F.col("rank") <= 3)
    rows = rows.withColumns({
        "suggested_bid_page": F.when(sure, F.col("suggested_bid_page")), "score": F.col("score") + F.when(sure, 3).otherwise(0),
        "evidence": F.when(sure, F.concat("evidence", F.array(F.lit(NAME_EVIDENCE["section"])))).otherwise(F.col("evidence")),
    })
    again = Window.partitionBy("name").orderBy(F.desc("score"), "rank")
    top = F.max("score").over(Window.partitionBy("name"))
    return rows.withColumns({"rank": F.row_number().over(again), "ambiguous": top < 3})
