"""Shapes of columns come with the parse and equal those by Spark's patterns; plain numbers and months are read the short way
with the same results; roles of a grid are found once, and only for chosen grids."""

import random

from pyspark.sql import functions as F

from millrace.functions import dates, notation
from millrace.functions.columns import bound, stripped
from millrace.operators import extract
from millrace.sources import html_grids as H

_CELLS = ["4.10", "$4.1000", "410", "410.25", "423-4", "423-4s", "1/2/2026", "-0.15", "+ .25", "+0-2", "+12", "-", "n/a", "1 Mar", "4.1 may", "+ jun", "March 1 - 15", "Mar 26", "ZCH6", "Corn", "corn 4.10", "mayor", "Dec", ""]


def test_shapes_equal_those_of_spark(spark):
    rng = random.Random(3)
    texts = _CELLS + ["".join(rng.choice("0123+-$./ marZcH_\x1c") for _ in range(rng.randrange(1, 9))).strip() for _ in range(1500)] + ["may " * 30]
    columns = [[t] for t in texts] + [[rng.choice(texts) for _ in range(rng.randrange(1, 12))] for _ in range(300)]
    rows = spark.createDataFrame([(k, [c for c in column if c]) for k, column in enumerate(columns)], "k int, cells array<string>")
    want = {r.k: r.s.asDict() for r in rows.select("k", extract.shape_shares(F.col("cells")).alias("s")).collect()}
    for k, column in enumerate(columns):
        assert H._shapes([[c] for c in column]) == [want[k]], column
    assert H._shapes([["4.10"], ["a", "b", "Corn"]])[2]["commodity"] == 1.0 and H._shapes([["4.10", "½"]]) is None


def test_a_page_beyond_ascii_has_the_same_grade(spark):
    page = "<h2>Corn{}</h2><table><tr><th>Delivery</th><th>Cash Bid</th><th>x</th></tr>" + "<tr><td>March 2026</td><td>4.1000</td><td>{}</td></tr>" * 3 + "</table>"
    pages = spark.createDataFrame([(1, page.format("", *"aaa")), (2, page.format("", *"ééé"))], "page_id long, html string")
    found = extract.graded(H.html_read(pages)).where("chosen").orderBy("page_id").collect()
    assert [(r.score, r.roles) for r in found] == [(14.0, ["delivery_period", "cash_price", None])] * 2


def test_short_readings_equal_whole_ones(spark):
    rng = random.Random(4)
    texts = ["", None, "4.1000", "-0.00", "+0.04", ".25", "50.01", "-51.5", "5.01", "-5.00", "0.00", "1,234.50", " 4.1 ", "4.1\n", "423-4", "12345.6", "4.1234567", "4.", ".", "-.5", "+-.5", "٤.٥"]
    texts += ["".join(rng.choice("0123456789+-. ") for _ in range(rng.randrange(1, 8))) for _ in range(1500)]
    df, raw = spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t")
    read = lambda text, then: bound(text, lambda x: notation._read(x, then))
    whole = [read(f(raw), g) for f, g in ((notation._bare, notation._price), (notation._bare, notation._basis), (stripped, notation._change))]
    for r in df.select("t", F.array(*(F.to_json(F.struct(c.alias("c"))) for c in whole)).alias("want"), F.array(*(F.to_json(F.struct(f(raw).alias("c"))) for f in (notation.price, notation.basis, notation.change))).alias("got")).collect():
        assert r.got == r.want, r.t
    months = ["March 2026", "feb 1997", "Feb. 2000", "Smarch 2026", "may2026", "March 1 - 15, 2026", "sept 0001", "March", "Oct/Nov", "harvest", "", None]
    df, ref = spark.createDataFrame([(t,) for t in months], "t string"), F.to_date(F.lit("2026-01-15"))
    slow = bound(stripped(raw), lambda t: bound(dates._found(t, F.lit("CORN")), lambda p: bound(dates._years(p, ref), lambda y: dates._window(t, p, y))))
    for r in df.select("t", dates.delivery(raw, ref, F.lit("CORN")).alias("got"), slow.alias("want")).collect():
        assert r.got == r.want, r.t
    assert df.select(dates._whole_month(F.lit("March 2026")).isNotNull().alias("x")).first().x


def test_roles_are_found_once(spark):
    page = "<h2>Corn</h2><table><tr><th>Delivery</th><th>Cash Bid</th></tr>" + "<tr><td>March 2026</td><td>4.1000</td></tr>" * 3 + "</table>"
    bids, _ = extract.extract_bids(spark.createDataFrame([(1, page)], "page_id long, html string"), F.to_date(F.lit("2026-01-05")))
    plan = bids.select("page_id", "cash_price")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[cash_price,basis]") == 1 and not any("cash_price,basis]" in line and "Filter" in line for line in plan.splitlines())
    assert [r.cash_price for r in bids.collect()] == [4.1] * 3


def test_rows_at_once_equal_the_librarys():
    rng = random.Random(9)
    cell = lambda: rng.choice(["<td>{}</td>", "<th>{}</th>", "<td>{}</th>", "<td>{}", "<td class='a'>{}</td>", "<TD>{}</TD>", "<td><b>{}</b></td>"][: rng.choice([2, 2, 7])]).format(rng.choice(["", " ", "x", " y z ", "1 > 0", "a &amp; b", "4.10"]))
    row = lambda: rng.choice(["<tr>{}</tr>", "<tr>{}</tr>", "<tr>{}", "<tr >{}</tr>", "<TR>{}</tr>"]).format("".join(cell() for _ in range(rng.randrange(4))))
    flat = lambda root: (root.words, [(x.tag, x.attrs, x.order, x.last, x.texts, x.upto, [p if isinstance(p, str) else p.order for p in x.parts], [c.order for c in x.children]) for x in root.walk()])
    for _ in range(3000):
        html = "".join(rng.choice(["<table>", "</table>", "<tr>", "<td>", "<p>", "<script>", "</script>", "<title>t</title>", row(), row(), row()]) for _ in range(rng.randrange(1, 9)))
        whole = H._Builder()
        whole.feed(html)
        whole.close()
        built = H._built(html)
        assert flat(built.root) == flat(whole.root) and built.nodes == list(built.root.walk()), html
