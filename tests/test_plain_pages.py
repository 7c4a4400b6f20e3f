"""What is plain in a page is read without the library's parser, and cells meet few patterns; results stay."""

import random
import re

from pyspark.sql import functions as F

from millrace.functions.columns import stripped
from millrace.operators.extract import SHAPES, shape_shares
from millrace.sources import html_grids as H

_BITS = [
    "<td>", "</td>", "<tr>", "<table>", "</table>", "<p class='a b'>", '<a href="/x?a=1&amp;b=2">', '<a href="/x">', "<a href=/x>", "</a>", "x", "&amp;", "&lt", "& ", "<", " ", ">", "<br/>",
    "<br />", "<img src='a\" b' alt=\"c'd\"/>", "<script>", "</script>", '<SCRIPT a="b">', "var t='</p>';", "<style>", "</style>", "<title>", "</title>", "<!-- c -->", "<!-- a -- b -->", "<!--->",
    "<!doctype html>", "<![if x]>", "<?pi>", "</>", "</ td>", "<td/>", "<td\tx=\"1\">", "<textarea>", "<p x='1'y='2'>", '<p X-a="">', "<ſcript>", "</ſtyle>", "</SCRIPT >", "<a\xa0b>", "\x00",
]


def _flat(root):
    return root.words, [(x.tag, x.attrs, x.order, x.last, x.texts, x.upto, [p if isinstance(p, str) else p.order for p in x.parts]) for x in root.walk()]


def _of_library(html):
    builder = H._Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def test_trees_equal_the_librarys():
    rng = random.Random(5)
    for _ in range(5000):
        html = "".join(rng.choice(_BITS) for _ in range(rng.randrange(1, 14)))
        assert _flat(H.parsed(html)) == _flat(_of_library(html)), html
    page = '<!DOCTYPE html><html><head><title>Bids</title><script>var t="</p>";</script></head><body><!-- x --><p class="a">1 &lt; 2<br/></p><table><tr><td>4.10</td></tr></table></body></html>'
    assert H._plain_start(H._Builder(), page) == len(page)


def test_shapes_by_first_character_equal_all_patterns(spark):
    rng = random.Random(7)
    cells = ["4.10", "$4.1000", "410", "410.25", "423-4", "423-4s", "1/2/2026", "-0.15", "+ .25", "+0-2", "+12", "-", "n/a", "1 Mar", "$", "4.1 may", "+ jun", "March 1 - 15", "Mar 26", "ZCH6", "z h26", "Corn", "corn 4.10", "mayor", "Dec", "١", "é"]
    cells += ["".join(rng.choice("0123+-$./ marZcH") for _ in range(rng.randrange(1, 9))).strip() or "x" for _ in range(2000)]
    got = {r.cell: r.s.asDict() for r in spark.createDataFrame([(c,) for c in cells], "cell string").select("cell", shape_shares(F.array("cell")).alias("s")).collect()}
    plain = {r.cell: r.asDict() for r in spark.createDataFrame([(c,) for c in cells], "cell string").select("cell", *(F.regexp_like("cell", F.lit(p)).cast("double").alias(n) for n, p in SHAPES.items())).collect()}
    assert all(got[c] == {n: plain[c][n] for n in SHAPES} for c in cells)


def test_every_blank_is_stripped(spark):
    ends = "".join(chr(c) for c in range(1, 0x3100) if re.match(r"\s", chr(c)) and chr(c) not in "\x1c\x1d\x1e\x1f")
    texts = [f"{c}a{c}b{c}{c}" for c in map(chr, range(1, 0x3100))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", stripped(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip(ends) for r in got)
    assert spark.createDataFrame([(None,)], "t string").select(stripped(F.col("t")).alias("s")).first().s == ""
