"""Workbooks of a run: what their sheets hold, by one plan for all companies."""

import re
import zipfile
from datetime import date, datetime

from pyspark.sql import functions as F

from millrace import settings
from millrace.operators import build

NOW = datetime(2026, 7, 2, 7, 30)
HEALTH = [
    ("Co0", "S0", "FRESH", date(2026, 7, 1), 1, 5, "no", "", "", "https://a.test/x?a=1&b=2"),
    ("Co1", "S1", "STALE", date(2026, 6, 1), 31, 5, "no", "old page", "look", "https://b.test/x"),
]
SCHEMA = "company string, location string, status string, as_of date, age_days int, rows long, same_as_last string, notices string, suggestion string, url string"


def bids(spark, companies):
    k = F.col("id")
    return spark.range(30).select(
        k.alias("bid_id"), (k % companies).alias("company_id"), F.concat(F.lit("Co"), k % companies).alias("company_name"), F.concat(F.lit("S"), k % 5).alias("site_label"), F.lit("https://a.test/x").alias("site_url"),
        F.when(k % 2 == 0, "CORN").otherwise("OATS").alias("commodity"), F.lit("c").alias("commodity_raw"), F.concat(F.lit("D"), k % 7).alias("delivery_raw"), F.lit(date(2026, 7, 1)).alias("delivery_start"), F.lit(None).cast("date").alias("delivery_end"),
        (k / 10).alias("cash_price"), F.lit(-0.1).alias("basis"), F.lit(None).cast("string").alias("futures_month"), F.lit("x").alias("futures_month_raw"), F.lit(1.0).alias("futures_price"), F.lit(0.0).alias("change"), F.lit(date(2026, 7, 1)).alias("page_as_of"), F.array(F.lit("year_inferred")).alias("notes"),
    )


def doc(**output):
    own = {"1": {"charts": "none", "columns": {"include_change": False, "highlight_best_bids": False}, "hyperlinks": False}}
    return settings.merged(settings.DEFAULTS, {"output": {"charts": "bars", **output}, "company_overrides": own})


def test_cover_health_and_own_sheets(spark, tmp_path):
    health = spark.createDataFrame(HEALTH, SCHEMA)
    (path,) = build.build_reports(bids(spark, 3), health, doc(workbook_modes=["master"]), tmp_path, 1, NOW)
    with zipfile.ZipFile(path) as z:
        book = z.read("xl/workbook.xml").decode()
        sheets = [z.read(f"xl/worksheets/sheet{k}.xml").decode() for k in range(1, 8)]
        links = z.read("xl/worksheets/_rels/sheet2.xml.rels").decode()
        charted = [n for n in z.namelist() if "/charts/" in n]
        assert "xl/worksheets/_rels/sheet4.xml.rels" not in z.namelist()  # Co1 has neither links nor charts
    assert re.findall('sheet name="([^"]*)"', book) == ["Summary", "Data Health", "Co0", "Co1", "Co2", "All Bids", "_ChartData"] and len(charted) == 2
    texts = re.findall(r">([^<>]+)</t>", sheets[0])
    at = [texts.index(t) for t in ("Freshness at a glance", "Best cash bids", "Needs attention", "Co1, S1: old page")]
    assert at == sorted(at) and texts[-2:] == ["STALE", "Co1, S1: old page"] and "3 companies, 30 bids" in texts
    assert 'Target="https://a.test/x?a=1&amp;b=2"' in links and 'ref="J7"' in sheets[1] and "a.test/x?a=1&amp;b=2</t>" in sheets[1]
    assert "Change" in sheets[2] and "colorScale" in sheets[2] and 'ref="A3"' in sheets[2]
    assert "Change" not in sheets[3] and "colorScale" not in sheets[3] and "hyperlink" not in sheets[3]
    for sheet, rows in zip(sheets[2:6], (10, 10, 10, 30), strict=True):
        assert [int(r) for r in re.findall(r'<row r="(\d+)"', sheet)][-rows:] == list(range(7, 7 + rows))


def test_jobs_do_not_grow_with_companies(spark, tmp_path):
    health, context = spark.createDataFrame(HEALTH, SCHEMA), spark.sparkContext
    jobs = {}
    for n in (2, 15):
        context.setJobGroup(f"reports of {n}", "")
        paths = build.build_reports(bids(spark, n), health, doc(workbook_modes=["per_company"]), tmp_path / str(n), 1, NOW)
        jobs[n] = len(context.statusTracker().getJobIdsForGroup(f"reports of {n}"))
        assert len(paths) == n
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[15] <= jobs[2] + 3  # adaptive stages may differ by a few


def test_nothing_to_report(spark, tmp_path):
    health = spark.createDataFrame([], SCHEMA)
    assert build.build_reports(bids(spark, 2).where("false"), health, doc(workbook_modes=["master", "per_company", "per_commodity"]), tmp_path / "out", 1, NOW) == []
    assert build.build_reports(bids(spark, 2).where("false"), health, doc(workbook_modes=["master"]), tmp_path / "out", 1, NOW) == []
    (path,) = build.build_reports(bids(spark, 2), health, doc(workbook_modes=["master"]), tmp_path / "out", 1, NOW)
    with zipfile.ZipFile(path) as z:
        assert "Everything looks up to date." in z.read("xl/worksheets/sheet1.xml").decode()
