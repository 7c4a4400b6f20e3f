"""A whole run over sites: which are fetched, how often, what is written, and how it is stopped."""

import tempfile
import threading
import time
from datetime import date, datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from millrace.operators import collect, store
from millrace.sources import fetch
from tests.test_pages import LIST, TABLE

VISITS = Path(tempfile.gettempdir()) / "millrace-test-visits"
LINKED = TABLE.replace("<table>", "<a href='/bids2'>Cash Bids West</a><a href='/grain/cash-bids'>Cash bids</a><table>", 1)
PAGES = {
    "https://a.test/bids": (200, LINKED), "https://a.test/robots.txt": (200, "User-agent: *\nDisallow: /private"), "https://b.test/private/bids": (200, TABLE),
    "https://b.test/robots.txt": (200, "User-agent: *\nDisallow: /private"), "https://d.test/bids": (200, LIST), "https://off.test/": (200, TABLE), "https://gone.test/": (200, TABLE),
}


def transport(url):
    with VISITS.open("a") as f:
        f.write(url + "\n")
    if "sleepy" in url:
        time.sleep(30)
    return PAGES.get(url, (404, ""))


def visits():
    found = sorted(VISITS.read_text().split()) if VISITS.exists() else []
    VISITS.unlink(missing_ok=True)
    return found


SITES = "site_id long, company_id long, url string, label string, enabled boolean"
ROWS = [
    (1, 10, "https://a.test/bids", "East", True), (2, 10, "https://a.test/bids2", "West", True), (3, 11, "https://b.test/private/bids", "", None), (4, 12, "https://d.test/bids", "Dee", True),
    (5, 10, "https://off.test/", "", False), (6, 13, "https://gone.test/", "", True),
]
FAST = {"politeness": (0, 0), "pauses": (0, 0)}


def test_a_run_of_all_parts(spark, tmp_path):
    sites = spark.createDataFrame(ROWS, SITES)
    companies = spark.createDataFrame([(10, False), (11, None), (12, False), (13, True)], "company_id long, archived boolean")
    s = store.Store(spark, str(tmp_path / "store"))
    now = datetime(2026, 3, 3, 8)
    visits()

    def run(k, at, **more):
        return collect.collect(s, sites, companies, k, "tests.test_collect:transport", today=F.lit(at.date()), now=F.lit(at), **FAST, **more).first()

    first = run(1, now)
    # robots texts of three domains, three pages; the one that is kept out, the one that is off and the archived company's are not visited
    assert visits() == ["https://a.test/bids", "https://a.test/bids2", "https://a.test/robots.txt", "https://b.test/robots.txt", "https://d.test/bids", "https://d.test/robots.txt"]
    assert (first.pages, first.rows, first.status) == (4, 5, "partial")
    outcomes = {r.site_id: (r.outcome, r.tier, r.roles is not None) for r in s.table("page_scans").collect()}
    assert outcomes == {1: ("ok", 1, True), 2: ("fetch_failed", None, False), 3: ("robots_blocked", None, False), 4: ("ok", 1, True)}
    assert {(r.site_id, r.code) for r in s.table("flags").collect()} == {(2, "HTTP_404"), (3, "ROBOTS_BLOCKED")}
    marked = spark.createDataFrame([], "site_id long, url string, status string, at timestamp")
    assert [(r.site_id, r.url, r.status) for r in collect.links(s, marked).collect()] == [(1, "https://a.test/grain/cash-bids", "candidate")]
    moved = spark.createDataFrame([(4, now + timedelta(days=1))], "site_id long, at timestamp")
    known = {r.site_id: (r.preferred_tier, r.tier_success_count, r.last_success_at is not None) for r in collect.memory(s, moved).collect()}
    assert known == {1: (1, 1, True), 2: (1, 0, False), 3: (1, 0, False), 4: (1, 0, False)}
    # half a day later the texts still hold; company by company gives the same
    second = run(2, now + timedelta(hours=12), batch_sites=2)
    assert [v for v in visits() if v.endswith("robots.txt")] == [] and (second.pages, second.rows) == (4, 5)
    # stopped after its first batch: what that stored counts
    third = run(3, now + timedelta(hours=13), batch_sites=1, stop=lambda: s.commits().where("run_id = 3").count() > 0)
    done = s.table("page_scans").where("run_id = 3").count()
    assert third is None and done == 0 or third.status == "partial" and third.pages == done < 4
    assert s.commits().where("run_id = 3").first().status == "partial"
    visits()


def test_jobs_of_a_run_can_be_stopped(spark, tmp_path):
    sites = spark.createDataFrame([(1, 10, "https://sleepy.test/bids", "", True)], SITES)
    companies = spark.createDataFrame([(10, False)], "company_id long, archived boolean")
    s, stopped = store.Store(spark, str(tmp_path / "store")), threading.Event()

    def stop():
        stopped.set()
        collect.cancel(spark, 7)

    began = time.perf_counter()
    timer = threading.Timer(8, stop)
    timer.start()
    got = collect.collect(s, sites, companies, 7, "tests.test_collect:transport", today=F.lit(date(2026, 3, 3)), now=F.lit(datetime(2026, 3, 3)), stop=stopped.is_set, **FAST)
    assert got.count() == 0 and time.perf_counter() - began < 28 and s.commits().first().status == "partial"
    visits()


def test_robots_as_of(spark):
    at = lambda h: datetime(2026, 3, 3) + timedelta(hours=h)
    cache = spark.createDataFrame([("a", "one", at(0)), ("a", "two", at(10)), ("b", None, at(5)), ("c", "x", at(30))], "domain string, body string, fetched_at timestamp")
    asked = [("a", at(9)), ("a", at(10)), ("a", at(33)), ("a", at(34)), ("b", at(6)), ("c", at(29)), ("d", at(1)), ("a", at(9))]
    got = {(r.domain, r.at): (r.body, r.known) for r in fetch.robots_as_of(spark.createDataFrame(asked, "domain string, at timestamp"), cache).collect()}
    assert got == {
        ("a", at(9)): ("one", True), ("a", at(10)): ("two", True), ("a", at(33)): ("two", True), ("a", at(34)): (None, False), ("b", at(6)): (None, True), ("c", at(29)): (None, False),
        ("d", at(1)): (None, False),
    }
