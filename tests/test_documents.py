"""Settings, schedule, workbooks, page source and the driver's entry points."""

import json
import re
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from millrace import schedule, settings
from millrace.operators import build, report, workbook
from millrace.sources import fetch
from millrace.sources.xlsx import ROWS, Workbooks

TRIED: list[str] = []


def transport(url):
    if "slow" in url:
        raise TimeoutError
    if "dead" in url:
        raise ConnectionError
    return (404, "") if "none" in url else (503, "") if "busy" in url else (200, f"<p>{url}</p>")


def test_settings(tmp_path):
    assert settings.load(tmp_path / "none.json") == settings.DEFAULTS
    path = tmp_path / "s.json"
    doc = settings.save(path, settings.DEFAULTS, {"output": {"sort_by": "cash_desc"}, "company_overrides": {"7": {"decimals": {"cash": 2}, "commodities": ["CORN"]}}})
    assert settings.load(path) == doc and doc["output"]["group_by"] == "commodity"
    own = settings.effective(doc, 7)
    assert own["decimals"] == {"cash": 2, "basis": 4, "futures": 4} and own["commodities"] == ["CORN"] and settings.effective(doc, 8)["commodities"] == []
    path.write_text("{ broken")
    assert settings.load(path) == settings.DEFAULTS


@pytest.mark.parametrize(
    ("patch", "field"),
    [
        ({"output": {"sort_by": "size"}}, "output.sort_by"), ({"nonsense": 1}, "nonsense"), ({"output": {"workbook_modes": []}}, "output.workbook_modes"),
        ({"output": {"horizon_months": 40}}, "output.horizon_months"), ({"output": {"hyperlinks": 1}}, "output.hyperlinks"), ({"output": {"horizon_months": True}}, "output.horizon_months"),
        ({"advanced": {"politeness_min_s": 9.0}}, "advanced.politeness_min_s"), ({"output": {"stale_thresholds": {"aging_days": 5}}}, "output.stale_thresholds.aging_days"),
        ({"output": {"filename_patterns": {"master": "{who}.xlsx"}}}, "output.filename_patterns.master"), ({"output": {"filename_patterns": {"master": "x.csv"}}}, "output.filename_patterns.master"),
        ({"company_overrides": {"1": {"archive": {}}}}, "company_overrides.1.archive"), ({"filters": {"commodities": [1]}}, "filters.commodities"),
    ],
)
def test_bad_settings(tmp_path, patch, field):
    path = tmp_path / "s.json"
    settings.save(path, settings.DEFAULTS, {})
    before = path.read_text()
    with pytest.raises(settings.SettingsError) as e:
        settings.save(path, settings.DEFAULTS, patch)
    assert e.value.field == field and path.read_text() == before


def test_schedule():
    now = datetime(2026, 7, 2, 8, 0)  # a Thursday
    assert schedule.next_fire(now, {"enabled": False}) is None
    assert schedule.next_fire(now, {"enabled": True, "hour": 7, "minute": 30}) == datetime(2026, 7, 3, 7, 30)
    assert schedule.next_fire(now, {"enabled": True, "day_of_week": "thu", "hour": 8, "minute": 30}) == datetime(2026, 7, 2, 8, 30)
    assert schedule.next_fire(now, {"enabled": True, "day_of_week": "thu", "hour": 8, "minute": 0}) == datetime(2026, 7, 9, 8, 0)
    assert schedule.still_due(datetime(2026, 7, 2, 7, 30), now) and not schedule.still_due(datetime(2026, 7, 2, 6, 30), now)


def test_names(tmp_path):
    taken: set[str] = set()
    assert [workbook.sheet_name(n, taken) for n in ("Coop: East/West", "coop  east west", "x" * 40, "")] == ["Coop East West", "coop east west (2)", "x" * 31, "Sheet"]
    assert workbook.file_name("{company} Bids {date}.xlsx", company='A/B: "C"', date="2026") == "A-B- -C- Bids 2026.xlsx"
    (tmp_path / "a.xlsx").write_text("")
    assert workbook.free_path(tmp_path, "a.xlsx").name == "a (2).xlsx" and workbook.free_path(tmp_path, "b.xlsx").name == "b.xlsx"


def test_archive(tmp_path):
    import os

    for k in range(4):
        (tmp_path / f"{k}.xlsx").write_text("")
        os.utime(tmp_path / f"{k}.xlsx", (k, k))
    assert workbook.archive_old(tmp_path, 2, "2026-07") == []
    assert sorted(p.name for p in tmp_path.glob("*.xlsx")) == ["2.xlsx", "3.xlsx"]
    assert sorted(p.name for p in (tmp_path / "Archive" / "2026-07").iterdir()) == ["0.xlsx", "1.xlsx"]


def xlsx_row(book, sheet, place, spec=None, cells=None, top=7):
    return (book, sheet, place, top, json.dumps(spec) if spec else None, cells)


def written(rows, folder, parts, **options):
    rows.sparkSession.dataSource.register(Workbooks)
    folder.mkdir(exist_ok=True)
    key = ["book", "sheet", "place"]
    dealt = rows.repartitionByRange(4, *key).sortWithinPartitions(*key)
    dealt.write.format("xlsx").mode("append").options(parts=str(parts), receipt=str(folder / "receipt"), **options).save(str(folder))
    return json.loads((folder / "receipt").read_text())


SPEC_OF_ONE = {"pattern": "{company} {date}.xlsx", "company": "A/B", "name": "Long", "title": ["t"], "headers": ["n", "text"], "kinds": ["number", "link"], "widths": [5.0, 9.0], "top": 7, "hidden": False, "best": True}


def test_sheets_from_many_tasks(spark, tmp_path):
    """A sheet whose rows lie in several tasks, in order; two books, clashing names of sheets, links, dates, what is no number."""
    long = spark.range(1, 2001).select(
        F.lit("a").alias("book"), F.lit(1).alias("sheet"), F.col("id").cast("int").alias("place"), F.lit(7).alias("top"), F.lit(None).cast("string").alias("spec"),
        F.array(build._cell("number", F.col("id")), build._cell("link", F.lit("x"), F.when(F.col("id") == 1500, "https://x.test/?a=1&b=2"))).alias("cells"),
    )
    odd = [("cash", "NaN", None), ("date", "2026-07-01", None), ("text", "<a>\x01", None), ("wrap", None, None), ("cash", "4.1", None)]
    more = [xlsx_row("a", 1, 0, SPEC_OF_ONE), xlsx_row("a", 2, 0, SPEC_OF_ONE | {"headers": ["c"] * 5, "kinds": [k for k, *_ in odd], "best": False}), xlsx_row("a", 2, 1, cells=odd), xlsx_row("b", 1, 0, SPEC_OF_ONE)]
    paths = written(long.unionByName(spark.createDataFrame(more, ROWS)), tmp_path / "out", tmp_path / "parts", tokens=json.dumps({"date": "d"}))
    assert paths == [str(tmp_path / "out" / n) for n in ("A-B d.xlsx", "A-B d (2).xlsx")] and not list((tmp_path / "parts").iterdir())
    with zipfile.ZipFile(paths[0]) as z:
        first, second, book, rels = (z.read(f"xl/{n}").decode() for n in ("worksheets/sheet1.xml", "worksheets/sheet2.xml", "workbook.xml", "worksheets/_rels/sheet1.xml.rels"))
    assert re.findall(r'<row r="(\d+)"', first) == ["1", "6", *map(str, range(7, 2007))] and re.findall(r"<v>(\d+)</v>", first) == [str(k) for k in range(1, 2001)]
    assert '<hyperlink ref="B1506" r:id="hB1506"/>' in first and 'Target="https://x.test/?a=1&amp;b=2"' in rels
    assert re.findall('sheet name="([^"]*)"', book) == ["Long", "Long (2)"]
    assert '<c r="A7" s="4"/>' in second and "<v>46204</v>" in second and "&lt;a&gt;</t>" in second and '<c r="D7" s="3"/>' in second and "<v>4.1</v>" in second and "colorScale" not in second


def test_a_failed_write_leaves_no_workbook(spark, tmp_path):
    cells = [("date", "no date", None)]
    rows = spark.createDataFrame([xlsx_row("a", 1, 0, SPEC_OF_ONE), *(xlsx_row("a", 1, k, cells=[("text", "x", None)]) for k in range(1, 50)), xlsx_row("a", 1, 50, cells=cells)], ROWS)
    with pytest.raises(Exception, match="no date"):
        written(rows, tmp_path / "out", tmp_path / "parts")
    assert not list((tmp_path / "out").iterdir()) and not list((tmp_path / "parts").glob("*"))
    with pytest.raises(Exception, match="say what it is"):
        written(rows.where("place between 1 and 9"), tmp_path / "out", tmp_path / "parts")
    assert not list((tmp_path / "out").iterdir())


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "Coop & Co", "East", "CORN", "corn", "Jul 2026", date(2026, 7, 1), None, 4.105, -0.15, None, "x", None, 0.0, date(2026, 7, 2), ["year_inferred"])],
        "bid_id long, company_name string, site_label string, commodity string, commodity_raw string, delivery_raw string, delivery_start date, delivery_end date, cash_price double, basis double, futures_month string, futures_month_raw string, futures_price double, change double, page_as_of date, notes array<string>",
    )
    rows = report.report_rows(df.withColumns({"company_id": F.lit(1), "site_url": F.lit("https://coop.test/bids")}), {}, F.lit(date(2026, 7, 2)))
    keys = report.column_keys({}, company=True, location=True)
    sheets = rows.select(F.lit("b").alias("book"), F.lit(1).alias("sheet"), "company_name", F.col("site_url").alias("page"), F.array(*map(F.lit, keys)).alias("keys"), F.lit("none").alias("charts"), F.lit(True).alias("best"), F.lit(True).alias("linked"))
    parts = build._bid_sheets(sheets, rows.crossJoin(sheets.select("book", "sheet", "keys", "charts")), name=F.lit("Coop"), title=F.array(F.lit("Coop bids")), pattern="w.xlsx")
    hidden = xlsx_row("b", 2, 0, {"pattern": "w.xlsx", "name": "_Data", "title": [], "headers": [], "kinds": ["text"], "widths": [9.0], "top": 1, "hidden": True, "best": False})
    all_rows = parts[0].unionByName(parts[1]).unionByName(spark.createDataFrame([hidden], ROWS))
    path = tmp_path / "out" / "w.xlsx"
    written(all_rows, tmp_path / "out", tmp_path / "parts", decimals=json.dumps({"cash": 2}))
    with zipfile.ZipFile(path) as z:
        assert not any("externalLinks" in n for n in z.namelist())
        body, book, styles = (z.read(f"xl/{n}").decode() for n in ("worksheets/sheet1.xml", "workbook.xml", "styles.xml"))
    assert 'topLeftCell="A7"' in body and 'ref="A6:M7"' in body and "Coop &amp; Co" in body and "<f>" not in body and "delivery year assumed" in body
    assert re.findall('sheet name="([^"]*)"', book) == ["Coop", "_Data"] and 'state="hidden"' in book
    assert "&quot;$&quot;#,##0.00" in styles or "'\"$\"#,##0.00'" in styles
    assert "46204" in body  # 1 July 2026


def test_pauses_that_a_server_asks_for_and_unknown_domains(monkeypatch):
    import socket

    slept: list[float] = []
    monkeypatch.setattr(fetch.time, "sleep", slept.append)
    answers = iter([(429, "", 7), (429, "", 900), (200, "<p>ok</p>")])
    assert fetch.one(lambda url: next(answers), "https://a.test/") == ("https://a.test/", 200, "<p>ok</p>", None) and slept == [7, fetch.LONGEST_WAIT]

    def unknown(url):
        raise socket.gaierror

    assert fetch.one(unknown, "https://no.test/") == ("https://no.test/", None, None, "DNS_FAIL") and len(slept) == 2


def test_pages_dealt_by_domain(spark):
    urls = spark.createDataFrame([(f"https://d{k % 5}.test/{k}{'none' if k % 7 == 0 else ''}",) for k in range(40)], "url string")
    got = {r.url: (r.status, r.error) for r in fetch.fetch_pages(urls, "tests.test_documents:transport", politeness=(0, 0)).collect()}
    assert len(got) == 40 and all(status == (404 if "none" in url else 200) and error is None for url, (status, error) in got.items())


def test_fetch(spark):
    urls = [f"https://{d}.test/{p}" for d, p in (("a", "1"), ("a", "2"), ("slow", ""), ("dead", ""), ("none", ""), ("busy", ""))]
    df = fetch.fetch(spark, urls, "tests.test_documents:transport", politeness_min_s=0, politeness_max_s=0, backoff=json.dumps([0, 0]))
    assert df.rdd.getNumPartitions() == 5
    got = {r.url: (r.status, r.error, r.flag) for r in df.withColumn("flag", fetch.status_flag(F.col("status"))).collect()}
    assert got["https://a.test/1"] == (200, None, None) and got["https://none.test/"] == (404, None, "HTTP_404") and got["https://busy.test/"] == (503, None, "HTTP_5XX")
    assert got["https://slow.test/"][1] == "TIMEOUT" and got["https://dead.test/"][1] == "NETWORK_FAIL"


def test_robots(spark):
    urls = spark.createDataFrame([("https://a.test/ok",), ("https://a.test/private/x",), ("https://b.test/x",)], "url string")
    robots = spark.createDataFrame([("a.test", "User-agent: *\nDisallow: /private")], "domain string, body string")
    assert sorted(r.url for r in fetch.allowed(urls, robots, "reader").collect()) == ["https://a.test/ok", "https://b.test/x"]


def test_entry_points():
    import __spark_entry__ as e

    named = e.queries()
    assert set(e.oracle_sql()) <= set(named) and "q01_latest_only" in named
    assert {f"q{n:02d}" for n in range(1, 43)} - {k[:3] for k in named} == set()


def test_the_library_works_without_the_optional_part():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
