"""Parsers against truth tables and against plain Python twins."""

import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, hashing, notation
from millrace.functions import text as T
from millrace.functions.fuzzy import header_role, indel, partial_ratio, token_set_ratio

REF = date(2026, 7, 2)


def run(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_price(spark):
    table = [("$5.1050", 5.105, []), ("5", 5.0, []), ("511-4", 5.115, []), ("511-4s", 5.115, []), (" 1,163.25 ", 11.6325, ["unit_assumed_cents"]), ("50", 50.0, []), ("51", 0.51, ["unit_assumed_cents"]),
             ("", None, []), (None, None, []), ("NA", None, []), ("-", None, []), ("closed", None, []), ("call", None, []), ("soon", None, []), (" 4.25 ", 4.25, []), ("bid 4.1 /bu", 4.1, [])]
    for (_, value, notes), r in zip(table, run(spark, [t[0] for t in table], notation.price), strict=True):
        assert r.value == (pytest.approx(value) if value is not None else None) and r.notes == notes


def test_basis(spark):
    table = [("-0.2150", -0.215, []), ("+.07", 0.07, []), ("-22", -0.22, ["unit_assumed_cents"]), ("+2", 2.0, []), ("3", 0.03, ["unit_assumed_cents"]), ("0.00", 0.0, []), ("-7.5", None, ["basis_out_of_range"]),
             ("-999", None, ["unit_assumed_cents", "basis_out_of_range"]), ("- 13", 0.13, ["unit_assumed_cents"]), ("n/a", None, []), ("-10-4", -0.105, [])]
    for (_, value, notes), r in zip(table, run(spark, [t[0] for t in table], notation.basis), strict=True):
        assert r.value == (pytest.approx(value) if value is not None else None) and r.notes == notes


def test_change(spark):
    table = [("+3-6", 0.0375), ("-0-2", -0.0025), ("-0.04", -0.04), ("unch", 0.0), ("UC", 0.0), ("-", 0.0), ("", None), (None, None), ("+4", 4.0), ("up", None)]
    got = run(spark, [t[0] for t in table], notation.change)
    assert got == [pytest.approx(v) if v is not None else None for _, v in table]


def test_every_eighth(spark):
    texts = [f"{sign}{whole}-{e}{s}" for sign in ("", "-", "+") for whole in (0, 7, 415, 1050) for e in range(8) for s in ("", "s")]
    want = [(-1 if t[0] == "-" else 1) * (int(t.lstrip("+-").split("-")[0]) + int(t.rstrip("s")[-1]) / 8) / 100 for t in texts]
    assert [r.value for r in run(spark, texts, notation.basis)] == [pytest.approx(w, abs=1e-6) for w in want]


def test_futures_month(spark):
    ref = F.lit(REF)
    table = [("Mar 27", "2027-03"), ("March '27 corn", "2027-03"), ("Sept. 2026", "2026-09"), ("ZCH27", "2027-03"), ("@c z6", "2026-12"), ("ZSF4", "2034-01"), ("ZWN5", "2025-07"), ("May", None), ("", None), ("ZCA26", None), ("Jul 85", "1985-07")]
    assert run(spark, [t[0] for t in table], lambda c: notation.futures_month(c, ref)) == [t[1] for t in table]


def test_grain(spark):
    table = [("Yellow Corn", "CORN"), ("#2 Yellow Corn", "CORN"), ("us #2 white corn", "WHITE_CORN"), ("New crop beans", "SOYBEANS"), ("Hard Red Spring Wheat 14%", "WHEAT_HRS"), ("KC wheat", "WHEAT_HRW"), ("No. 1 soybeans", "SOYBEANS"),
             ("wheat", "WHEAT"), ("MILO", "SORGHUM"), ("buckwheatish", None), ("", None), (None, None), ("#2", None)]
    assert run(spark, [t[0] for t in table], notation.grain) == [t[1] for t in table]


def test_delivery(spark):
    d = date
    table = [
        ("9/1/26 - 9/15/2026", d(2026, 9, 1), d(2026, 9, 15), []), ("Aug 20 - Sep 10", d(2026, 8, 20), d(2026, 9, 10), ["year_inferred"]),
        ("December 15 - January 15", d(2026, 12, 15), d(2027, 1, 15), ["year_inferred"]), ("Nov 5 - Dec 5, 2027", d(2027, 11, 5), d(2027, 12, 5), []),
        ("August 1 – 15", d(2026, 8, 1), d(2026, 8, 15), ["year_inferred"]), ("June 10 - 31, 2027", d(2027, 6, 10), d(2027, 6, 30), []),
        ("November 2026", d(2026, 11, 1), d(2026, 11, 30), []), ("Feb 2027", d(2027, 2, 1), None, []), ("Feb 2028", d(2028, 2, 1), d(2028, 2, 29), []),
        ("Nov/Dec", d(2026, 11, 1), d(2026, 12, 31), ["year_inferred"]), ("Dec / Jan", d(2026, 12, 1), d(2027, 1, 31), ["year_inferred"]),
        ("March", d(2027, 3, 1), d(2027, 3, 31), ["year_inferred"]), ("sept.", d(2026, 9, 1), d(2026, 9, 30), ["year_inferred"]),
        ("harvest delivery", d(2026, 10, 1), d(2026, 11, 30), ["newcrop_window_assumed"]), ("Sep 26", None, None, ["delivery_unparsed"]), ("13/1/26 - 2/30/26", None, None, []), ("", None, None, []),
    ]
    got = run(spark, [t[0] for t in table], lambda c: dates.delivery(c, F.lit(REF), F.lit(None).cast("string")))
    for (text, start, end, notes), r in zip(table, got, strict=True):
        assert (r.start, r.end, r.notes) == (start, end, notes), text
    spring = run(spark, ["New Crop"], lambda c: dates.delivery(c, F.lit(REF), F.lit("WHEAT_HRS")))[0]
    assert (spring.start, spring.end) == (d(2026, 8, 1), d(2026, 9, 15))
    late = run(spark, ["Jan 5 - 20"], lambda c: dates.delivery(c, F.lit(d(2026, 12, 20)), F.lit("CORN")))[0]
    assert (late.start, late.end) == (d(2027, 1, 5), d(2027, 1, 20))


def test_page_dates(spark):
    assert run(spark, ["Bids for Friday, March 06, 2026", "as of 3/6/26", "3/6/26 close", "soon", None], dates.as_of) == [date(2026, 3, 6), None, date(2026, 3, 6), None, None]
    assert run(spark, ["3/6/2026 1:15", "Updated May 1, 2026", "2/30/26", ""], dates.last_update) == [date(2026, 3, 6), date(2026, 5, 1), None, None]


def test_hashes(spark):
    h = lambda *p: hashlib.sha256("|".join(p).encode()).hexdigest()[:32]
    values = [k / 800 for k in range(-900, 900, 7)] + [None, 0.0]
    df = spark.createDataFrame([(v, -0.5) for v in values], "a double, b double")
    got = {r.a: r.h for r in df.select("a", hashing.value_hash(F.col("a"), F.col("b")).alias("h")).collect()}
    assert got == {v: h("" if v is None else f"{v:.4f}", "-0.5000") for v in values}
    rows = spark.createDataFrame([("x", "1"), ("a", "2")], "r string, v string")
    signature = rows.agg(hashing.content_signature(F.col("r"), F.col("v")).alias("s")).first().s
    assert signature == h("a:2", "x:1") == rows.orderBy("r").agg(hashing.content_signature(F.col("r"), F.col("v")).alias("s")).first().s


def test_similarity():
    assert indel("abcd", "abxd") == pytest.approx(75) and indel("", "") == 100
    assert token_set_ratio("cash bid", "bid") == 100 and token_set_ratio("", "x") == 0
    assert partial_ratio("coop", "the coop elevator") == 100 and 0 < partial_ratio("coop", "cop") < 100
    roles = {"Futures Month": "futures_price", "Cash Price": "cash_price", "Delivery": "delivery_period", "Delivry": "delivery_period", "Comodity": "commodity", "Basis Change": "basis", "Chg": "change", "": None, "???": None, "zzzz": None}
    assert {h: header_role(h) for h in roles} == roles


def test_likeness_equals_the_plain_table():
    import random

    r = random.Random(5)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0

    for n in [*range(12)] * 60 + [90, 200]:
        a, b = ("".join(r.choice("abcé ") for _ in range(r.randint(0, n))) for _ in "ab")
        assert indel(a, b) == indel(b, a) == plain(a, b)
        least = r.choice([0.0, 50.0, 72.0, 90.0])
        exact, bounded = token_set_ratio(a, b), token_set_ratio(a, b, least)
        assert bounded == exact if exact >= least else bounded < least
        short, long = sorted((a, b), key=len)
        stretches = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))]
        assert partial_ratio(a, b) == (max(plain(short, s) for s in stretches) if short else 0.0 if long else 100.0)


def test_urls(spark):
    assert run(spark, ["coop.example/bids", "http://a.b", "nodots", "", None], T.normalized_url) == ["https://coop.example/bids", "http://a.b", None, None, None]
    assert run(spark, ["www.coop.com:80", "wwwheat.co.uk", "localhost"], T.registered_domain) == ["coop.com", "co.uk", "localhost"]
    assert run(spark, ["www.wheat.com"], T.registered_domain) == ["heat.com"]
    assert run(spark, ["www.wheat.com"], lambda c: T.registered_domain(c, strip_letters=False)) == ["wheat.com"]
    assert run(spark, ["https://X.y/A/B?q#f", "/Rel/Path?x"], T.path) == ["/a/b", "/rel/path"]
    assert run(spark, ["Corn and soybean and beans today", "nothing"], T.grains_mentioned) == [["Corn", "Soybeans"], []]
