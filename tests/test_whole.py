"""Queries take every row and every character, against plain Python."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from millrace.operators import links
from millrace.plans import catalog


def test_first_overlap_takes_every_site(spark, tmp_path):
    rng = random.Random(3)
    day = datetime(1995, 1, 1)
    rows = [(rng.randrange(1, 30), rng.choice("ab"), day + timedelta(days=rng.randrange(8), hours=rng.randrange(24))) for _ in range(90)]
    spark.createDataFrame(rows, "o_custkey long, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    items = defaultdict(set)
    for site, grp, at in rows:
        items[grp, site].add(at.date())
    want = {}
    for (grp, a), own in items.items():
        for (other, b), its in items.items():
            if grp == other and a != b and len(own & its) >= 0.3 * len(own):
                want[a] = min(b, want.get(a, b))
    got = {r.site: r.other for r in catalog.QUERIES["q47_first_overlap"](spark, str(tmp_path)).collect()}
    assert got == want and any(x % 7 for x in got) and any(got[x] % 7 for x in got if x % 7 == 0)


def test_hits_count_in_the_whole_text(spark, tmp_path):
    text = "4.10 -0.15 " + "word " * 50_000 + "4.20 +0.25"
    spark.createDataFrame([(1, text), (2, "4.10"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.prices, r.bases) for r in catalog.QUERIES["q13_pattern_hits"](spark, str(tmp_path)).collect()}
    assert got == {1: (4, 2), 2: (1, 0), 3: (None, None)}
    # a first look at a page stays a look at its head
    page = spark.createDataFrame([(1, "https://a.test/bids", f"<p>{text} 4.30</p>")], "page_id long, url string, html string")
    assert [(r.price_hits, r.basis_hits, r.looks_like_bid_page) for r in links.probe(page).collect()] == [(2, 1, False)]
