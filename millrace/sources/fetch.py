"""Web pages as a DataFrame: a Python data source that reads URLs through a transport given by the caller.

The transport is a function in an importable module, named as "package.module:function"; it takes a URL and returns
(status, text) or raises OSError. No network code is part of this library. One partition per domain, so that a domain's
pages are read one after the other, with a pause between them.
"""

from __future__ import annotations

import importlib
import json
import random
import socket
import time
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import urlparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIES, BACKOFF = 2, (5.0, 15.0)
RETRIED = (500, 502, 503, 504)
LONGEST_WAIT = 120.0
ROBOTS_CHARS, ROBOTS_HOURS = 100_000, 24

SCHEMA = "url string, status int, html string, error string"


def status_flag(status: Column) -> Column:
    """The code of what is wrong with an HTTP status; null if nothing is."""
    return (
        F.when(status.between(200, 299), None).when(status.isin(404, 410), "HTTP_404").when(status.isin(401, 403, 406), "HTTP_403_BOTBLOCK")
        .when(status >= 500, "HTTP_5XX").when(status == 429, "HTTP_429").otherwise("NETWORK_FAIL")
    )


@lru_cache(maxsize=1000)
def _rules(body: str) -> RobotFileParser:
    rules = RobotFileParser()
    rules.parse(body[:ROBOTS_CHARS].splitlines())
    return rules


def _domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1))


def allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """urls(url) less those that their domain's robots text, robots(domain, body), forbids to `agent` or to everyone.

    No text for a domain allows everything. A worker parses a text once for all the URLs that it meets it with.
    """

    def may(urls: pd.Series, bodies: pd.Series) -> pd.Series:
        said = (None if body is None else _rules(body) for body in bodies)
        return pd.Series([r is None or (r.can_fetch(agent, url) and r.can_fetch("*", url)) for url, r in zip(urls, said, strict=True)], dtype=bool)

    judge = F.pandas_udf(may, "boolean")
    return urls.withColumn("domain", _domain(F.col("url"))).join(robots, "domain", "left").where(judge("url", "body")).select("url")


def robots_as_of(asked: DataFrame, cache: DataFrame, hours: int = ROBOTS_HOURS) -> DataFrame:
    """For each (domain, at) that is asked for: body, the newest text in cache(domain, body, fetched_at) that is not later than
    that and less than `hours` old, and known, whether there is one (a domain may have none, which is known as well).

    An as-of join by one window: texts and times of a domain stand in one order, and each time takes the last text before
    it. As no text lasts longer, a domain's order is cut into stretches of `hours`, and a text stands in its own and the
    next one: neither a domain that most pages are of nor a long history meets in one task.
    """
    width = hours * 3600
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    times = asked.select("domain", "at").distinct().withColumn("stretch", F.floor(seconds(F.col("at")) / width))
    own = F.floor(seconds(F.col("fetched_at")) / width)
    texts = cache.select("domain", F.col("fetched_at").alias("at"), F.explode(F.array(own, own + 1)).alias("stretch"), F.struct("fetched_at", "body").alias("text"))
    both = times.withColumn("text", F.lit(None).cast(texts.schema["text"].dataType)).unionByName(texts)
    order = Window.partitionBy("domain", "stretch").orderBy("at", F.col("text").isNull(), "text.body").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("last", F.last("text", ignorenulls=True).over(order)).where("text IS NULL")
    fresh = F.coalesce(seconds(F.col("at")) - seconds(F.col("last.fetched_at")) < width, F.lit(False))
    return found.select("domain", "at", F.when(fresh, F.col("last.body")).alias("body"), fresh.alias("known"))


def fetch_robots(domains: DataFrame, transport: str, at: Column, **options: object) -> DataFrame:
    """domain, body, fetched_at of the robots texts of domains(domain, scheme): null where there is none or it can't be read."""
    urls = domains.select("domain", F.concat(F.coalesce("scheme", F.lit("https")), F.lit("://"), "domain", F.lit("/robots.txt")).alias("url"))
    got = fetch_pages(urls.select("url"), transport, **options)
    body = F.when(F.col("status") == 200, F.substring("html", 1, ROBOTS_CHARS))
    return urls.join(got, "url").select("domain", body.alias("body"), at.alias("fetched_at"))


def one(get: Callable[[str], tuple], url: str, pauses: list[float] | tuple[float, ...] = BACKOFF) -> tuple:
    """(url, status, html, error) of one page. Faults of the server are tried again after a pause, and 429 after what it
    asks for, if the transport gives that as a third value (seconds)."""
    status, text, error, asked = None, None, None, None
    for attempt in range(RETRIES + 1):
        if attempt:
            pause = pauses[min(attempt, len(pauses)) - 1]
            time.sleep(min(LONGEST_WAIT, pause if asked is None else asked))
        asked = None
        try:
            status, text, *more = get(url)
            error = None
            if status == 429 and more:
                asked = more[0]
        except TimeoutError:
            error = "TIMEOUT"
        except socket.gaierror:
            error = "DNS_FAIL"
        except OSError:
            error = "NETWORK_FAIL"
        if error == "DNS_FAIL" or (error is None and status not in RETRIED and status != 429):
            break
    return url, status, text, error


def fetch_pages(urls: DataFrame, transport: str, *, politeness: tuple[float, float] = (2.0, 5.0), pauses: tuple[float, ...] = BACKOFF) -> DataFrame:
    """As fetch, for any number of urls(url): they are dealt by domain, and a domain's pages are read one after the other,
    with a pause between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, name = transport.partition(":")
        get = getattr(importlib.import_module(module), name)
        before = None
        for batch in batches:
            rows = []
            for url, domain in zip(batch["url"], batch["domain"], strict=True):
                if domain == before:
                    time.sleep(random.uniform(*politeness))
                before = domain
                rows.append(one(get, url, pauses))
            frame = pd.DataFrame(rows, columns=["url", "status", "html", "error"])
            yield frame.astype({"status": "Int32"})

    dealt = urls.select("url", _domain(F.col("url")).alias("domain")).repartition("domain").sortWithinPartitions("domain", "url")
    return dealt.mapInPandas(run, SCHEMA)


class _Domain(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])
        self.transport = options["transport"]
        self.low, self.high = float(options.get("politeness_min_s", 2)), float(options.get("politeness_max_s", 5))
        self.pauses = [float(x) for x in json.loads(options.get("backoff", json.dumps(BACKOFF)))]

    def partitions(self) -> list[_Domain]:
        by: dict[str, list[str]] = {}
        for url in self.urls:
            by.setdefault(urlparse(url).netloc.lower(), []).append(url)
        return [_Domain(urls) for urls in by.values()]

    def read(self, partition: _Domain) -> Iterator[tuple]:
        module, _, name = self.transport.partition(":")
        get = getattr(importlib.import_module(module), name)
        for k, url in enumerate(partition.urls):
            if k:
                time.sleep(random.uniform(self.low, self.high))
            yield self._one(get, url)

    def _one(self, get, url: str) -> tuple:
        return one(get, url, self.pauses)


class PageSource(DataSource):
    """spark.dataSource.register(PageSource), then spark.read.format("webpages").options(urls=json, transport="m:f")."""

    @classmethod
    def name(cls) -> str:
        return "webpages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def fetch(spark: SparkSession, urls: list[str], transport: str, **options: object) -> DataFrame:
    spark.dataSource.register(PageSource)
    reader = spark.read.format("webpages").option("urls", json.dumps(urls)).option("transport", transport)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()
