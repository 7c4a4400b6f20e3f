"""Extraction, links and names over small pages of our own."""

import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.operators import links
from millrace.operators.extract import extract_bids, with_hashes
from millrace.sources import html_grids as html_grids_module
from millrace.sources.html_grids import _page, html_grids, html_links, html_texts, parsed

TABLE = """<html><head><title>Coop bids</title></head><body><p>Cash bids for Monday, March 02, 2026</p><h3>Soybeans</h3><table>
<tr><th>Delivery</th><th>Cash</th><th>Basis</th><th>Futures</th></tr>
<tr><td>Mar 2026</td><td>10.1500</td><td>-0.35</td><td>1050-0</td></tr><tr><td>Delivery</td><td>Cash</td><td>Basis</td><td>Futures</td></tr>
<tr><td>New Crop</td><td>9.9000</td><td>-0.60</td><td>1050-0s</td></tr></table></body></html>"""
LIST = "<div class='cbCommodity'><h2>#2 Yellow Corn</h2>" + "".join(
    f"<ul class='row'><li>{d}</li><li>{c:.4f}</li><li>{b:+.4f}</li><li>{f}</li><li>{m}</li></ul>"
    for d, c, b, f, m in [("April 1 - 15", 4.10, -0.15, "425-0", "May 26"), ("July 1 - 15", 4.25, -0.10, "435-0", "Jul 26"), ("Oct 2026", 4.05, -0.40, "445-0s", "Dec 26")]
) + "</div>"
GRID = "<section><h4>Milo prices</h4><div>" + "".join(f"<div class='r'><span>{d}</span><span>{c}</span><span>{b}</span></div>" for d, c, b in [("March 2026", "3.9500", "-0.45"), ("May 2026", "4.0000", "-0.40"), ("July 2026", "4.0500", "-0.35")]) + "</div></section>"
SIGNED = "<h2>Corn</h2><table><tr><th>Delivery</th><th>Cash Price</th><th>Futures Price</th><th>A</th><th>B</th></tr>" + "".join(
    f"<tr><td>{d} 2026</td><td>4.10</td><td>423-0</td><td>+0.02</td><td>-0.13</td></tr>" for d in ("March", "May", "July")
) + "</table>"
NOTHING = "<p>Welcome</p><ul><li>one</li><li>two</li></ul>"
HTML = {1: TABLE, 2: LIST, 3: GRID, 4: SIGNED, 5: NOTHING, 6: "", 7: None}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, f"https://coop.example/p{k}", h) for k, h in HTML.items()], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def read(pages):
    bids, results = extract_bids(pages, F.lit(date(2026, 3, 2)))
    return bids.orderBy("page_id", "grid", "row").collect(), {r.page_id: r for r in results.collect()}


def of(read, page):
    return [b for b in read[0] if b.page_id == page]


def test_table_with_repeated_header(read):
    rows = of(read, 1)
    assert [(b.commodity, b.cash_price, b.basis, b.futures_price) for b in rows] == [("SOYBEANS", 10.15, -0.35, 10.5), ("SOYBEANS", 9.9, -0.6, 10.5)]
    assert rows[0].delivery_start == date(2026, 3, 1) and rows[1].delivery_start == date(2026, 10, 1)
    assert rows[1].notes == ["newcrop_window_assumed"] and rows[1].confidence == 1.0
    result = read[1][1]
    assert (result.as_of_date, result.n_rows, result.flags) == (date(2026, 3, 2), 2, []) and result.score >= 8


def test_list_grid(read):
    rows = of(read, 2)
    assert [(b.commodity, b.cash_price, b.basis, b.futures_price, b.futures_month) for b in rows] == [
        ("CORN", 4.1, -0.15, 4.25, "2026-05"), ("CORN", 4.25, -0.1, 4.35, "2026-07"), ("CORN", 4.05, -0.4, 4.45, "2026-12")
    ]
    assert all(abs(b.cash_price - b.basis - b.futures_price) < 0.03 for b in rows)


def test_grid_without_header(read):
    assert [(b.commodity, b.cash_price, b.basis, b.delivery_start.month) for b in of(read, 3)] == [("SORGHUM", 3.95, -0.45, 3), ("SORGHUM", 4.0, -0.4, 5), ("SORGHUM", 4.05, -0.35, 7)]


def test_basis_and_change_are_told_apart(read):
    assert {(b.basis, b.change) for b in of(read, 4)} == {(-0.13, 0.02)}


def test_pages_without_bids(read):
    assert [(read[1][k].n_rows, read[1][k].flags) for k in (5, 6, 7)] == [(0, ["NO_BID_DATA"])] * 3


def test_identities(spark, read):
    schema = "page_id long, n int, site_id long, location_label string, commodity string, commodity_raw string, delivery_raw string, delivery_start date, delivery_end date, futures_month string, cash_price double, basis double, futures_price double, change double, notes array<string>"
    row = (1, 7, None, "CORN", "corn", "May", date(2026, 5, 1), None, None, 4.1, None, None, None, [])
    df = spark.createDataFrame([(row[0], 0, *row[1:]), (row[0], 1, *row[1:]), (2, 0, *row[1:])], schema)
    got = with_hashes(df, page=["page_id"], ordinal=["n"]).orderBy("page_id", "n").collect()
    assert got[0].row_hash == got[2].row_hash != got[1].row_hash and len({r.value_hash for r in got}) == 1
    assert got[1].notes == ["duplicate_identity_disambiguated"] and got[0].notes == []


def test_dom():
    root = parsed("<ul><li>a<li>b <b>c</b></ul><p>x<p>y<br>z<script>var s='<td>'</script>")
    assert [x.text() for x in root.walk() if x.tag == "li"] == ["a", "b c"]
    assert [x.text() for x in root.walk() if x.tag == "p"] == ["x", "y z"]


def test_grids_texts_and_links(spark, pages):
    spanned = spark.createDataFrame([(1, "<table><tr><td colspan='2'>a</td><td>1</td></tr><tr><td>b</td><td>2</td><td>3</td></tr></table><script>go('/x/cash-bids')</script><a href='/y'>Y <i>z</i></a>")], "page_id long, html string")
    assert html_grids(spanned).first().rows == [["a", "a", "1"], ["b", "2", "3"]] or html_grids(spanned).first().header == ["a", "a", "1"]
    assert [(r.href, r.anchor_text) for r in html_links(spanned).orderBy("nth").collect()] == [("/y", "Y z"), ("/x/cash-bids", "")]
    assert html_texts(pages).where("page_id = 1").first().title == "Coop bids"


ODD = ["<p><![foo]>a<![if x]><table><tr><td colspan='²'>a<td colspan=99999999>b<td>c<tr><td>1.25<td>2.50<td>-0.10</table>", "<![CDATA[ x ]]>", "<!DOCTYPE", "<table><tr><td colspan='-3'>x", "&#xFFFFFFFF; &#0;", "<" * 5000, "<div>" * 3000]


def test_odd_pages_do_not_stop_the_others(spark):
    df = spark.createDataFrame([(k, "https://a.test/", h) for k, h in enumerate([*ODD, TABLE])], "page_id long, url string, html string")
    bids, results = extract_bids(df, F.lit(date(2026, 3, 2)))
    got = {r.page_id: r for r in results.collect()}
    assert len(got) == len(ODD) + 1 and not any(r.crashed for r in got.values()) and got[len(ODD)].n_rows == 2
    assert max(len(row) for g in html_grids(df).collect() for row in g.rows) <= 1003
    assert html_texts(df).count() == len(ODD) + 1 and html_links(df).count() == 0


def test_a_page_that_cannot_be_worked_on_is_its_own_outcome(spark):
    """The parser meets what it can't take: a text that is no text."""
    df = spark.createDataFrame([(1, bytearray(b"<table><tr><td>x")), (2, bytearray(b""))], "page_id long, html binary")
    _, results = extract_bids(df, F.lit(date(2026, 3, 2)))
    assert {r.page_id: (r.crashed, r.flags) for r in results.collect()} == {1: (True, ["SCAN_INTERNAL_ERROR"]), 2: (False, ["NO_BID_DATA"])}


def test_trees_of_many_open_elements_take_time_by_their_size():
    import time

    took = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        root = parsed("<div><b>" * n + "<p>x" * n + "</i>" * n)
        took.append(time.perf_counter() - began)
        assert sum(x.tag == "p" for x in root.walk()) == n
    assert took[1] < 12 * took[0] + 1


def test_discovery(spark):
    html = """<a href="/cashbidssingle-12/">Cash Bids</a><a href="/cashbidssingle-11">here</a><a href="mailto:a@b.c">x</a><a href="https://elsewhere.test/cashbids">y</a>
    <a href="/news/cashbids">News</a><a href="/about">About</a><a href="/grain#top">Grain</a><a href="/markets/grain/bids">Bids</a>"""
    pages = spark.createDataFrame([(1, "https://coop.example/home", html)], "page_id long, url string, html string")
    known = spark.createDataFrame([(1, "https://coop.example/CashBidsSingle-11")], "page_id long, known_url string")
    got = links.discover(pages, known).orderBy("rank").collect()
    assert [(r.url, r.score) for r in got] == [("https://coop.example/cashbidssingle-12", 12.0), ("https://coop.example/markets/grain/bids", 4.0), ("https://coop.example/news/cashbids", 1.0)][: len(got)] and len(got) == 2
    assert "sibling of a known bid page" in got[0].reasons


def test_probe(spark):
    page = "<title>T</title><p>Corn 4.10 4.20 4.30 -0.15</p>"
    df = spark.createDataFrame([(1, "https://a.b/", page), (2, "https://a.b/bids", "<p>nothing</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in links.probe(df).collect()}
    assert got[1].looks_like_bid_page and got[1].commodities == ["Corn"] and got[1].price_hits == 4 and not got[2].looks_like_bid_page


def test_names(spark):
    rows = [
        ("Prairie Coop", 1, "https://www.facebook.com/prairiecoop", "Prairie Coop", ""), ("Prairie Coop", 2, "https://www.prairie-coop.test/cash-bids", "Prairie Coop - Cash Bids", "x"),
        ("Prairie Coop", 3, "https://prairie-coop.test/", "Home", ""), ("Prairie Coop", 4, "https://other.test/", "Weather", "sunny"),
    ]
    got = links.resolve_names(spark.createDataFrame(rows, "name string, nth int, url string, title string, snippet string")).collect()
    assert [(r.domain, r.rank, r.ambiguous) for r in got] == [("prairie-coop.test", 1, False)] and got[0].score >= 9


def _timed(html):
    began = time.perf_counter()
    grids = _page(html)[1]
    return time.perf_counter() - began, grids


def test_pages_of_very_many_tables_take_time_by_their_size():
    for html in (
        "<table><tr><td>x" * 1000, "<table><tr><td>x " * 1000 + "</table>" * 1000, "<table><tr>" + "<td colspan=1000>" + "word " * 1000 * 20 + "<td colspan=1000>y" * 2000,
        "<h2>Corn</h2><table><tr><th>a<th>b<tr><td>1<td>2</table>" * 1000,
    ):
        took, grids = _timed(html)
        assert took < 2 and sum(len(r) for g in grids for r in g["rows"]) <= html_grids_module.MAX_CELLS
    assert len(grids) == 1000 and all(g["context"] == "Corn" and g["rows"] == [["1", "2"]] for g in grids)


def test_tables_in_tables(monkeypatch):
    """A layout table has the lines of what it holds, unless that would be too much: then each table has its own."""
    inner = "<table><tr><th>Delivery</th><th>Cash</th></tr><tr><td>Mar</td><td>4.10</td></tr></table>"
    html = f"<table><tr><td>left</td><td>right {inner}</td></tr><tr><td colspan=2>1 below</td></tr></table>"
    outer, own = _page(html)[1]
    assert outer["header"] == ["left", "right Delivery Cash Mar 4.10", "Delivery", "Cash", "Mar", "4.10"]
    assert outer["rows"] == [["Delivery", "Cash"], ["Mar", "4.10"], ["1 below", "1 below"]]
    assert (own["header"], own["rows"]) == (["Delivery", "Cash"], [["Mar", "4.10"]]) and outer["anchor"] < own["anchor"] <= outer["last"]
    for name, most in (("MAX_CELLS", 5), ("MAX_CHARS", 20)):
        with monkeypatch.context() as m:
            m.setattr(html_grids_module, name, most)
            outer, own = _page(html)[1]
        assert (outer["header"], outer["rows"]) == (["left", "right"], [["1 below"]]) and (own["header"], own["rows"]) == (["Delivery", "Cash"], [["Mar", "4.10"]])


def test_groups_that_hold_too_much_are_the_page_s_outcome(spark, monkeypatch):
    monkeypatch.setattr(html_grids_module, "MAX_CHARS", 200)
    with pytest.raises(ValueError):
        _page("<div>" + "<p><b>one</b><b>two</b><b>three</b></p>" * 30 + "</div>")
