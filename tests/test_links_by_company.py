"""Known pages are given once for each company: a scan's links don't pair every page with every site of its company."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import links, scan

HTML = '<a href="/bids-3">Cash Bids</a><a href="/bids-9">Cash Bids</a><a href="/cashbids">Cash Bids</a>'


def test_known_by_company_is_known_by_page(spark):
    pages = spark.createDataFrame([(k, k % 2, f"https://c{k % 2}.test/bids-{k}", HTML) for k in range(1, 6)], "page_id long, company_id int, url string, html string")
    known = pages.select("company_id", F.col("url").alias("known_url"))
    of_page = pages.select("page_id", "company_id").join(known, "company_id").drop("company_id")
    told = lambda df: sorted((r.page_id, r.url, r.score, r.rank, r.reasons) for r in df.collect())
    got = told(links.discover(pages, known, by="company_id"))
    assert got == told(links.discover(pages.drop("company_id"), of_page)) and {r[:2] for r in got} >= {(1, "https://c1.test/bids-9"), (2, "https://c0.test/bids-3")}
    assert (1, "https://c1.test/bids-3") not in {r[:2] for r in got}


def test_a_scans_links_make_no_pairs_of_sites(spark):
    sites = spark.createDataFrame([(k, 1, f"https://c.test/bids-{k}", "") for k in range(4)], "site_id long, company_id long, url string, label string")
    pages = spark.createDataFrame([(k, HTML) for k in range(4)], "site_id long, html string")
    scans = spark.createDataFrame([(k, 1) for k in range(4)], "site_id long, rows_extracted long")
    found = scan._links(pages, scans, sites, F.lit(datetime(2026, 1, 5)))
    assert {r.url for r in found.collect()} == {"https://c.test/bids-9", "https://c.test/cashbids"}
    assert not re.search(r"Join Inner, \(company_id#\d+L? = company_id#\d+L?\)", found._jdf.queryExecution().optimizedPlan().toString())
