"""Views, quality rules, reports and streams."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import aliases, links, quality, registry, report, store
from millrace.plans import catalog
from millrace.streaming import bids as stream

TODAY = date(2026, 7, 2)


def test_latest_before_filters(spark):
    """A bid that a later run replaced is gone from the earlier run's report as well."""
    bids = spark.createDataFrame([(1, 10, "h", 5, 1, 4.0), (2, 11, "h", 5, 1, 4.1), (3, 10, "k", 5, 1, 3.9)], "bid_id long, page_scan_id long, row_hash string, site_id long, company_id long, cash_price double").withColumn("commodity", F.lit("CORN"))
    scans = spark.createDataFrame([(10, 1, TODAY), (11, 2, TODAY)], "page_scan_id long, run_id long, as_of_date date")
    companies, sites = spark.createDataFrame([(1, "Coop")], "company_id long, name string"), spark.createDataFrame([(5, "East", "u")], "site_id long, label string, url string")
    ids = lambda **k: sorted(r.bid_id for r in store.query_bids(bids, scans, companies, sites, **k).collect())
    assert ids(run_id=1) == [3] and ids(run_id=2) == [2] and ids(run_id=1, latest_only=False) == [1, 3]
    assert ids(commodities=["OATS"]) == [] and ids(commodities=[], company_ids=[1]) == [2, 3]


def test_store_log(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), "url string, at int, label string, deleted boolean")
    s.append("sites", rows(("a", 1, "old", None), ("b", 1, "b", None)))
    s.append("sites", rows(("a", 2, "new", False), ("b", 3, None, True)))
    assert [(r.url, r.label) for r in s.current("sites", ["url"], [F.desc("at")]).collect()] == [("a", "new")]
    view = store.upsert_view(s.table("sites"), ["url"], "at", "label")
    assert sorted((r.url, r.first_seen_at, r.last_seen_at, r.label) for r in view.collect()) == [("a", 1, 2, "new"), ("b", 1, 3, None)]


def test_freshness_and_flags(spark):
    df = spark.createDataFrame([(d,) for d in (TODAY, date(2026, 6, 30), date(2026, 6, 29), date(2026, 6, 27), None)], "d date")
    got = [r.s for r in df.select(quality.freshness(F.col("d"), F.lit(TODAY)).alias("s")).collect()]
    assert got == ["FRESH", "FRESH", "AGING", "STALE", "AGING"]
    pages = spark.createDataFrame([(1, date(2026, 6, 27)), (2, TODAY), (3, None)], "site_id long, as_of_date date")
    bids = spark.createDataFrame([(2, date(2026, 6, 1)), (2, None), (1, date(2026, 8, 1)), (3, None)], "site_id long, delivery_end date")
    assert sorted((r.site_id, r.code) for r in quality.stale_dates(pages, bids, F.lit(TODAY)).collect()) == [(1, "STALE_ASOF"), (2, "STALE_DELIVERY")]


def test_repeats(spark):
    scans = [(1, k, s, datetime(2026, 7, k)) for k, s in enumerate("abba", 1)] + [(2, k, "x", datetime(2026, 7, k)) for k in (1, 4)] + [(3, 9, None, datetime(2026, 7, 1)), (4, 1, "q", datetime(2026, 7, 1))]
    df = spark.createDataFrame(scans, "site_id long, scan_id long, content_signature string, fetched_at timestamp")
    streak = {r.site_id: r.streak for r in quality.repeat_streak(df, key="site_id", signature="content_signature", newest=[F.desc("scan_id")]).collect()}
    assert streak == {1: 1, 2: 2, 4: 1}
    flagged = quality.repeated_scans(df, F.lit(datetime(2026, 7, 4)))
    assert [(r.site_id, r.n_scans) for r in flagged.collect()] == [(2, 3)]
    assert quality.repeated_scans(df, F.lit(datetime(2026, 7, 2))).count() == 0


def test_overlaps(spark):
    rows = [("c", 1, h) for h in "abcde"] + [("c", 2, h) for h in "abcdxyz"] + [("d", 3, h) for h in "abcde"] + [("c", 1, "a")]
    df = spark.createDataFrame(rows, "company string, site long, h string")
    got = quality.overlaps(df, group="company", member="site", item="h")
    assert [(r.site, r.other, r.share) for r in got.collect()] == [(1, 2, 0.8)]
    assert quality.first_overlap(got, member="site").count() == 1


def test_best_bids(spark):
    rows = [(1, "CORN", 4.0, date(2026, 8, 1)), (2, "CORN", 4.0, date(2026, 8, 2)), (3, "CORN", 4.5, None), (4, "CORN", 9.0, date(2027, 1, 1)), (5, None, 10.0, None), (6, "OATS", None, None)]
    df = spark.createDataFrame(rows, "bid_id long, commodity string, cash_price double, delivery_start date")
    got = quality.best_bids(df, F.lit(TODAY), order=[F.asc("bid_id")])
    assert sorted((r.commodity, r.window, r.bid_id) for r in got.collect()) == [("CORN", "Deferred", 4), ("CORN", "Nearby", 1)]


def test_health_and_attention(spark):
    site = "site_id long, company string, location string, url string"
    pages = spark.createDataFrame([(1, "A", "x", "u1", TODAY, 4), (2, "A", "y", "u2", date(2026, 6, 20), 1), (3, "B", "z", "u3", date(2026, 6, 29), 2)], site + ", as_of date, rows long")
    sites = spark.createDataFrame([(k, c, loc, f"u{k}") for k, c, loc in ((1, "A", "x"), (2, "A", "y"), (3, "B", "z"), (9, "C", "gone"))], site)
    flags = spark.createDataFrame([(1, 1, "PARTIAL_COLUMNS", "m", "s"), (9, 2, "TIMEOUT", "took too long", "retry"), (9, 3, "HTTP_404", "later", "")], "site_id long, nth long, code string, message string, suggestion string")
    health = quality.page_health(pages, spark.createDataFrame([(1, 3), (2, 1)], "site_id long, streak long"), flags, sites, F.lit(TODAY))
    got = {r.location: r for r in health.collect()}
    assert [(k, got[k].status, got[k].same_as_last) for k in ("x", "y", "z", "gone")] == [("x", "FRESH", "Yes ×3"), ("y", "STALE", "No"), ("z", "AGING", "No"), ("gone", "FAILED", "")]
    assert got["gone"].notices == "took too long" and "Jun 20" in got["y"].notices and "3 days" in got["z"].notices and got["x"].suggestion
    assert {r.location: r.kind for r in quality.attention(health).collect()} == {"y": "STALE", "gone": "FAILED"}


def test_run_status(spark):
    df = spark.createDataFrame([(1, "ok", 3, 0), (1, "robots_blocked", 0, 1), (2, "ok", 1, 0), (2, "no_data", 0, 1)], "run_id long, outcome string, rows_extracted long, n_flags long")
    assert sorted((r.run_id, r.rows, r.status) for r in quality.run_status(df).collect()) == [(1, 3, "complete"), (2, 1, "partial")]


def test_report_order_and_columns(spark):
    rows = [(1, "B", "CORN", None, 4.0), (2, "A", None, date(2026, 8, 1), 0.0), (3, "A", "CORN", date(2026, 7, 1), 5.0), (4, "A", "CORN", date(2028, 7, 1), 5.0)]
    df = spark.createDataFrame(rows, "bid_id long, site_label string, commodity string, delivery_start date, cash_price double").withColumn("company_name", F.lit("c"))
    order = lambda **k: [r.bid_id for r in report.report_rows(df, k, F.lit(TODAY)).orderBy("place").collect()]
    assert order(horizon_months=12) == [3, 1, 2] and order() == [3, 4, 1, 2]
    assert order(sort_by="cash_desc", group_by="none") == [3, 4, 1, 2] and order(group_by="location", locations=["A"]) == [3, 2, 4]
    breaks = [r.breaks for r in report.report_rows(df, {"group_by": "commodity"}, F.lit(TODAY)).orderBy("place").collect()]
    assert breaks == [False, False, False, True]
    assert report.column_keys({"columns": {"include_change": False, "include_flags": False}}, company=True, location=False) == ["company", "commodity", "delivery", "start", "end", "cash", "basis", "fut_month", "futures", "asof"]


def test_streams(spark, tmp_path):
    schema = "site long, scan long, signature string"
    for k, part in enumerate([[(1, 1, "a"), (1, 2, "a"), (2, 1, "x")], [(1, 3, "b"), (2, 3, "x"), (2, 2, "y")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stream.append_stream(live, f"{tmp_path}/log", f"{tmp_path}/c1")
        out = stream.streaks(live, key="site", signature="signature", order=F.lpad(F.col("scan").cast("string"), 5, "0"))
        out.writeStream.outputMode("update").foreachBatch(lambda b, n, k=k: b.write.mode("overwrite").parquet(f"{tmp_path}/out{k}")).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/log")
    assert sorted((r.site, r.scan, r.signature) for r in stream.current(log, ["site"], [F.desc("scan")]).collect()) == [(1, 3, "b"), (2, 3, "x")]
    read = lambda k: {r.key: r.streak for r in spark.read.parquet(f"{tmp_path}/out{k}").collect()}
    assert read(0) == {1: 2, 2: 1} and read(1) == {1: 1, 2: 1}


@pytest.mark.parametrize("name", ["q01_latest_only", "q19_group_sort", "q30_delivery", "q41_discover"])
def test_queries_equal_their_sql(spark, name):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.sql(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def plain_overlaps(rows, least):
    held = {}
    for g, m, i in rows:
        if i is not None:
            held.setdefault((g, m), set()).add(i)
    return {(g, a, b, len(x & y) / len(x)) for (g, a), x in held.items() for (h, b), y in held.items() if g == h and a != b and x & y and len(x & y) / len(x) >= least}


def test_overlaps_by_rare_items_and_by_all(spark):
    import random

    rng = random.Random(3)
    rows = [(g, m, rng.choice([0, 0, 1, 2, 3, None, 10 + m, 20 + rng.randrange(4)])) for g in range(2) for m in range(12) for _ in range(rng.randrange(1, 9))]
    rows += [(0, 50, i) for i in range(5)] + [(0, 51, i) for i in range(4)] + [(1, 50, 7), (1, 51, 7)]
    df = spark.createDataFrame(rows, "g int, m int, i int")
    for least in (0.3, 0.6, 0.8, 1.0):
        got = {tuple(r) for r in quality.overlaps(df, group="g", member="m", item="i", least=least).collect()}
        assert got == plain_overlaps(rows, least), least


def test_places_by_group_and_without(spark):
    """Places, breaks and shades as one pass over sorted rows gives them; names that are sorted as one still break."""
    import random
    from datetime import date

    from pyspark.sql import functions as F

    from millrace.operators import report

    rng = random.Random(5)
    rows = [(k, rng.choice(["corn", "milo", None, "", "zzz"]), rng.choice(["A", "B", None]), "one", rng.choice([None, 0.0, 4.1, 4.2]), rng.choice([None, date(2026, 3, 1), date(2026, 4, 1)])) for k in range(60)]
    df = spark.createDataFrame(rows, "bid_id int, commodity string, site_label string, company_name string, cash_price double, delivery_start date").repartition(4)
    first = lambda x: (x is not None, x if x is not None else 0)
    for group_by, sort_by in (("commodity", "cash_desc"), ("location", "delivery_start"), ("none", "commodity")):
        name = {"commodity": 1, "location": 2}.get(group_by)
        key = {"cash_desc": lambda r: -r[4] if r[4] else 999.0, "delivery_start": lambda r: r[5] or date(2100, 1, 1), "commodity": lambda r: r[1] or "zzz"}[sort_by]
        order = sorted(rows, key=lambda r: (r[name] or "zzz" if name else "", key(r), first(r[3]), first(r[1]) if r[1] is not None else (False, ""), (r[5] is not None, r[5] or date.min), r[0]))
        want = [(r[0], k + 1, bool(name and k and r[name] != order[k - 1][name]), k % 2 == 1) for k, r in enumerate(order)]
        got = report.report_rows(df, {"group_by": group_by, "sort_by": sort_by}, F.lit(date(2026, 1, 1)))
        assert [(r.bid_id, r.place, r.breaks, r.shaded) for r in got.orderBy("place").collect()] == want, group_by


def test_deletions_spread(spark):
    """A company that is deleted twice and made again, a site of it with a new start, and one of another company."""
    at = lambda d: datetime(2026, 3, d)
    companies = spark.createDataFrame([(1, at(1), False), (1, at(4), True), (1, at(5), False), (1, at(8), True), (1, at(9), False), (2, at(1), False)], "company_id long, at timestamp, deleted boolean")
    sites = spark.createDataFrame(
        [(10, 1, at(1), False), (10, 1, at(5), False), (10, 1, at(9), False), (11, 1, at(2), False), (20, 2, at(1), False), (21, 2, at(1), False), (21, 2, at(3), True)],
        "site_id long, company_id long, at timestamp, deleted boolean",
    )
    bids = spark.createDataFrame([(k, s, at(d)) for k, (s, d) in enumerate([(10, 2), (10, 6), (10, 10), (11, 3), (20, 2), (21, 2), (21, 3), (21, 4), (None, 1)])], "bid_id long, site_id long, at timestamp")
    left = registry.cascade(companies, sites, {"bids": bids, "flags": bids.withColumnRenamed("at", "told")}, at={"flags": "told"})
    assert {(r.company_id, r.at.day) for r in left["companies"].collect()} == {(1, 9), (2, 1)}
    assert {(r.site_id, r.at.day) for r in left["sites"].collect()} == {(10, 9), (20, 1)}
    assert {r.bid_id for r in left["bids"].collect()} == {r.bid_id for r in left["flags"].collect()} == {2, 4, 7, 8}


def test_lists_of_domains(spark):
    rows = spark.createDataFrame([("a.b.example",), ("b.example",), ("xb.example",), (None,), ("",), ("c.test",)], "domain string")
    listed = spark.createDataFrame([("B.example",), ("d.c.test",), ("b.example",)], "domain string")
    assert sorted((str(r.domain), r.listed) for r in links.on_list(rows, listed).collect()) == [("", False), ("None", False), ("a.b.example", True), ("b.example", True), ("c.test", False), ("xb.example", False)]


def test_names_by_a_table_of_aliases(spark):
    known = spark.createDataFrame([("corn", "CORN"), ("yellow corn", "YC"), ("Winter  Wheat", "WW"), ("hard red winter wheat", "HRW"), ("", "none")], "alias string, name string")
    rows = spark.createDataFrame([("#2 Yellow Corn",), ("popcorn",), ("HARD RED WINTER WHEAT, corn",), ("winter-wheat",), (None,), ("",), ("corn corn",)], "text string")
    got = sorted((str(r.text), r.commodity) for r in aliases.named(rows, "text", known).collect())
    assert got == [("", None), ("#2 Yellow Corn", "YC"), ("HARD RED WINTER WHEAT, corn", "HRW"), ("None", None), ("corn corn", "CORN"), ("popcorn", None), ("winter-wheat", "WW")]


def test_rows_are_numbered_over_many_tasks(spark):
    """One group for all rows, some without a name: its rows are in all partitions, their places without a gap."""
    many = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in many}
    for k, v in many.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(5000).select(F.lit("CORN").alias("c"), (F.col("id") * 7919 % 5003).alias("v"), F.when(F.col("id") % 3 == 0, "a").alias("g"))
        rows = report.numbered(df, [F.col("c"), F.col("v")], "g").withColumn("task", F.spark_partition_id()).orderBy("place").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.place for r in rows] == list(range(1, 5001)) and not rows[0].breaks and [r.shaded for r in rows[:3]] == [False, True, False]
    assert all(a.v < b.v and b.breaks == (a.g != b.g) for a, b in zip(rows, rows[1:], strict=False)) and len({r.task for r in rows}) >= 3
    assert report.numbered(df.limit(0), [F.col("c")], None).count() == 0
