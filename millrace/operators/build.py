"""Workbooks of a run: one for all companies, one for each, or one for each grain."""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import settings as S
from millrace.operators import quality, report
from millrace.operators.workbook import CHART_SHEET, archive_old
from millrace.sources.xlsx import ROWS, SPEC, Workbooks

_HEALTH = [("company", "Company", 22, "text"), ("location", "Location", 16, "text"), ("status", "Status", 10, "text"), ("as_of", "Bids As Of", 12, "date"), ("age_days", "Age", 8, "number"), ("rows", "Bids", 8, "number"), ("same_as_last", "Same As Last", 12, "text"), ("notices", "Notices", 60, "wrap"), ("suggestion", "Suggestion", 40, "wrap"), ("url", "Page", 40, "link")]
_FRESH = [("company", "Company", "text"), ("location", "Location", "text"), ("as_of", "Bids As Of", "date"), ("age_days", "Age", "number"), ("status", "Status", "text"), ("rows", "Bids", "number")]
_BEST = [("commodity", "Commodity", "text"), ("window", "Delivery", "text"), ("cash_price", "Cash Bid", "cash"), ("basis", "Basis", "basis"), ("delivery_raw", "Period", "text"), ("company_name", "Company", "text"), ("site_label", "Location", "text")]
#: Sheets of a book: the cover, health, then companies by rank, all bids, and what charts draw from.
_COVER, _HEALTH_SHEET, _COMPANIES, _ALL, _CHARTS = 1, 2, 10, 2_000_000_000, 2_000_000_001
_TOP = 7
#: Points of a chart; a chart of fewer than so many isn't drawn.
POINTS = 40
_DRAWN = [("bars", "bar", "cash_price", F.max, "Cash bid by delivery", 2), ("lines", "line", "basis", F.avg, "Basis by delivery", 3)]


def _cell(kind: str, value: Column, url: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), (F.lit(None) if url is None else url).cast("string").alias("url"))


def _texts(*texts: str) -> Column:
    return F.array(*map(F.lit, texts)) if texts else F.array().cast("array<string>")


def _spec(**said: Column | str | int | bool | list) -> Column:
    """A JSON text of SPEC; what isn't said is null."""
    of = lambda v: v if isinstance(v, Column) else F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    kinds = {f.split(" ", 1)[0]: f.split(" ", 1)[1] for f in SPEC.replace(", ", "\n").split("\n")}
    return F.to_json(F.struct(*(of(said[k]).cast(t).alias(k) if k in said else F.lit(None).cast(t).alias(k) for k, t in kinds.items())))


def _rows(df: DataFrame, book: Column, sheet: Column, place: Column, top: int, *, spec: Column | None = None, cells: Column | None = None) -> DataFrame:
    """As the data source takes them."""
    types = {f.split(" ", 1)[0]: f.split(" ", 1)[1] for f in ROWS.split(", ")}
    value = {"book": book, "sheet": sheet, "place": place, "top": F.lit(top), "spec": F.lit(None) if spec is None else spec, "cells": F.lit(None) if cells is None else cells}
    return df.select(*(value[k].cast(t).alias(k) for k, t in types.items()))


def _own_sheets(spark: SparkSession, doc: dict, common: dict, *, location: bool) -> DataFrame:
    """What sheets of companies with settings of their own show: keys of columns, charts, whether prices are shaded and pages linked."""
    rows = []
    for company in doc.get("company_overrides", {}):
        own = S.effective(doc, company)
        rows.append((str(company), report.column_keys(own, company=False, location=location), own["charts"], own["columns"].get("highlight_best_bids", True), own["hyperlinks"]))
    return spark.createDataFrame(rows, "company string, keys array<string>, charts string, best boolean, linked boolean")


def _company_sheets(rows: DataFrame, partition: list[str], own: DataFrame, keys: list[str], common: dict) -> DataFrame:
    """A row for each sheet: the columns `partition`, the company, its rank by name within them, what its sheet shows."""
    pages = rows.groupBy(*partition, "company_id", "company_name").agg(F.min_by("site_url", "place").alias("page"))
    rank = Window.partitionBy(*map(F.col, partition)).orderBy("company_name", "company_id")  # over a row for each company
    said = pages.withColumn("rank", F.row_number().over(rank)).join(own, F.col("company_id").cast("string") == F.col("company"), "left")
    usual = {"keys": _texts(*keys), "charts": F.lit(common["charts"]), "best": F.lit(common["columns"].get("highlight_best_bids", True)), "linked": F.lit(common["hyperlinks"])}
    return said.withColumns({k: F.coalesce(k, v) for k, v in usual.items()}).drop("company")


def _of_columns(keys: Column, of: int) -> Column:
    """Headers, widths or kinds (1, 2, 3 of report.COLUMNS) of a sheet's columns."""
    every = F.array(*(F.struct(F.lit(c[0]).alias("key"), F.lit(c[of]).alias("v")) for c in report.COLUMNS))
    return F.transform(F.filter(every, lambda c: F.array_contains(keys, c["key"])), lambda c: c["v"])


def _bid_cells(keys: Column) -> Column:
    """Cells of a bid under the wanted keys, in the order of report.COLUMNS."""
    value = report.shown_values()
    every = F.array(*(F.struct(F.lit(k).alias("key"), _cell(kind, value[k]).alias("cell")) for k, _, _, kind in report.COLUMNS))
    return F.transform(F.filter(every, lambda c: F.array_contains(keys, c["key"])), lambda c: c["cell"])


def _points(rows: DataFrame) -> DataFrame:
    """(book, sheet, nth, kind, title, delivery, value, at): what the charts of sheets draw. Bars show the best cash price of
    a delivery, lines its mean basis; a sheet's deliveries, a row each, are numbered by their first place."""
    found = None
    for nth, (mode, kind, value, of, title, least) in enumerate(_DRAWN):
        chosen = rows.where(F.col("charts").isin(mode, "both") & F.col(value).isNotNull())
        by = chosen.groupBy("book", "sheet", "delivery_raw").agg(F.min("place").alias("first"), of(value).alias("value"))
        w = Window.partitionBy("book", "sheet")
        by = by.withColumns({"at": F.row_number().over(w.orderBy("first")), "n": F.count("*").over(w)}).where((F.col("n") >= least) & (F.col("at") <= POINTS))
        part = by.select("book", "sheet", F.lit(nth).alias("nth"), F.lit(kind).alias("kind"), F.lit(title).alias("title"), F.coalesce("delivery_raw", F.lit("")).alias("delivery"), "value", "at")
        found = part if found is None else found.unionByName(part)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("book").orderBy("sheet", "nth", "at")))


def _bid_sheets(sheets: DataFrame, rows: DataFrame, *, name: Column, title: Column, pattern: str, commodity: Column | None = None) -> list[DataFrame]:
    """sheets: book, sheet, company_name, page, keys, charts, best, linked. rows: the same with bids and their places."""
    points = _points(rows)
    drawn = points.groupBy("book", "sheet", "nth", "kind", "title").agg(F.min("place").alias("first"), F.count("*").cast("int").alias("count"))
    drawn = drawn.groupBy("book", "sheet").agg(F.array_sort(F.collect_list(F.struct("nth", "kind", "title", "first", "count"))).alias("found"))  # two at most
    charts = F.transform("found", lambda c: F.struct(c["kind"].alias("kind"), c["title"].alias("title"), c["first"].alias("first"), c["count"].alias("count")))
    said = sheets.join(drawn, ["book", "sheet"], "left")
    grain = F.lit(None) if commodity is None else commodity
    spec = _spec(
        pattern=pattern, company=F.col("company_name"), commodity=grain, name=name, title=title, link=F.when(F.col("linked"), F.nullif("page", F.lit(""))), headers=_of_columns(F.col("keys"), 1),
        widths=_of_columns(F.col("keys"), 2), kinds=_of_columns(F.col("keys"), 3), top=_TOP, hidden=False, best=F.col("best"), charts=charts,
    )
    hidden = _spec(pattern=pattern, company=F.col("company"), name=CHART_SHEET, title=_texts(), headers=_texts(), kinds=["text", "number"], widths=[20.0, 10.0], top=1, hidden=True, best=False)
    owners = sheets.groupBy("book").agg(F.min("company_name").alias("company"))  # a book of one company has its name
    with_charts = points.select("book").distinct().join(owners, "book")
    return [
        _rows(said, F.col("book"), F.col("sheet"), F.lit(0), _TOP, spec=spec),
        _rows(rows, F.col("book"), F.col("sheet"), F.col("place"), _TOP, cells=_bid_cells(F.col("keys"))),
        _rows(with_charts, F.col("book"), F.lit(_CHARTS), F.lit(0), 1, spec=hidden),
        _rows(points, F.col("book"), F.lit(_CHARTS), F.col("place"), 1, cells=F.array(_cell("text", F.col("delivery")), _cell("number", F.col("value")))),
    ]


def _one(spark: SparkSession) -> DataFrame:
    return spark.range(1)


def cover_rows(health: DataFrame, best: DataFrame) -> DataFrame:
    """(place, cells): how fresh pages are, the best bids, and what to look at, below each other in one order of rows."""
    spark = health.sparkSession

    def line(section: int, df: DataFrame, cells: Column, *keys: Column) -> DataFrame:
        """Rows of a section, in the order of its keys."""
        filled = [*keys, F.lit(""), F.lit(""), F.lit("")][:3]
        return df.select(F.lit(section).alias("section"), *(k.cast("string").alias(f"k{i}") for i, k in enumerate(filled)), cells.alias("cells"))

    head = lambda section, *texts: line(section, _one(spark), F.array(*(_cell("head", F.lit(t)) for t in texts)))
    blank = lambda section: line(section, _one(spark), F.array(_cell("text", F.lit(None))))
    attention = quality.attention(health)
    message = F.concat(F.coalesce("company", F.lit("")), F.lit(", "), F.coalesce("location", F.lit("")), F.lit(": "), F.coalesce("notices", F.lit("")))
    none = attention.agg(F.count("*").alias("n")).where("n = 0")
    parts = [
        head(10, "Freshness at a glance"), head(11, *(h for _, h, _ in _FRESH)),
        line(12, health, F.array(*(_cell(kind, F.col(k)) for k, _, kind in _FRESH)), F.col("company"), F.col("location"), F.col("url")),
        blank(20), head(21, "Best cash bids"), head(22, *(h for _, h, _ in _BEST)),
        line(23, best, F.array(*(_cell(kind, F.col(k)) for k, _, kind in _BEST)), F.col("commodity"), F.when(F.col("window") == "Nearby", "1").otherwise("2"), F.lit("")),
        blank(30), head(31, "Needs attention"),
        line(32, attention, F.array(_cell("text", F.col("kind")), _cell("text", message)), F.col("company"), F.col("location"), F.col("url")),
        line(33, none, F.array(_cell("text", F.lit("Everything looks up to date.")))),
    ]
    all_parts = parts[0]
    for part in parts[1:]:
        all_parts = all_parts.unionByName(part)
    return report.numbered(all_parts, [F.col(c) for c in ("section", "k0", "k1", "k2")], None).select("place", "cells")


def report_rows_of_all(bids: DataFrame, health: DataFrame, doc: dict, now: datetime, shared: str) -> DataFrame | None:
    """All rows of all workbooks that the settings ask for, as sources/xlsx.py takes them; None if no bid is left.

    Bids, health and each order of the bids are written to the folder `shared` once; sheets read them from there.
    """
    base = f"{shared.rstrip('/')}/reports-{uuid.uuid4().hex}"

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{base}/{name}")

    bids, health = kept("bids", bids), kept("health", health)
    spark, today, common = bids.sparkSession, F.lit(now.date()), S.effective(doc)
    output, when = doc["output"], f"Scanned {now:%b %d, %Y %I:%M %p}"
    patterns, modes = output["filename_patterns"], output["workbook_modes"]
    parts: list[DataFrame] = []
    if {"master", "per_company"} & set(modes):
        of_all = kept("companies", report.company_rows(bids, spark.createDataFrame(S.overrides(doc), S.OVERRIDES), common, today))
    carried = ["book", "sheet", "keys", "charts"]

    def sheets_of(rows: DataFrame, sheets: DataFrame, on: list[str]) -> DataFrame:
        return rows.join(sheets.select(*on, *carried), on)

    if "master" in modes:
        all_rows = kept("all", report.report_rows(bids, common, today))
        total = all_rows.agg(F.count("*").alias("bids"), F.count_distinct("company_id").alias("companies")).first()
        if total.bids:
            book = F.lit("1")
            title = [F.lit("Cash bids"), F.lit(f"{total.companies} companies, {total.bids} bids"), F.lit(when)]
            best = quality.best_bids(bids, today, order=report.order_keys("commodity", "delivery_start"))
            cover = kept("cover", cover_rows(health, best))
            spec = _spec(pattern=patterns["master"], name="Summary", title=F.array(*title), headers=_texts(), kinds=["text"], widths=[22.0, 16.0, 13.0, 12.0, 20.0, 22.0, 16.0], top=5, hidden=False, best=False)
            parts.append(_rows(_one(spark), book, F.lit(_COVER), F.lit(0), 5, spec=spec))
            parts.append(_rows(cover, book, F.lit(_COVER), F.col("place"), 5, cells=F.col("cells")))
            if output["include_health_sheet"]:
                spec = _spec(pattern=patterns["master"], name="Data Health", title=_texts("Data health", when), headers=[h for _, h, *_ in _HEALTH], kinds=[k for *_, k in _HEALTH], widths=[float(w) for *_, w, _ in _HEALTH], top=_TOP, hidden=False, best=False)
                placed = kept("placed", report.numbered(health, [F.col(c) for c in ("company", "location", "url")], None))
                page = F.nullif("url", F.lit(""))
                cells = [_cell(kind, F.regexp_replace(k, "^[A-Za-z]+://", ""), page if common["hyperlinks"] else None) if k == "url" else _cell(kind, F.col(k)) for k, _, _, kind in _HEALTH]
                parts.append(_rows(_one(spark), book, F.lit(_HEALTH_SHEET), F.lit(0), _TOP, spec=spec))
                parts.append(_rows(placed, book, F.lit(_HEALTH_SHEET), F.col("place"), _TOP, cells=F.array(*cells)))
            location = output["master"]["sheet_per"] == "company"
            keys = report.column_keys(common, company=False, location=location)
            sheets = _company_sheets(of_all, [], _own_sheets(spark, doc, common, location=location), keys, common)
            sheets = sheets.where(F.col("rank") <= output["max_data_sheets_per_workbook"]).withColumns({"book": book, "sheet": F.col("rank") + _COMPANIES})
            parts += _bid_sheets(sheets, sheets_of(of_all, sheets, ["company_id", "company_name"]), name=F.col("company_name"), title=F.array("company_name", F.lit("Cash bids"), F.lit(when)), pattern=patterns["master"])
            if output["master"]["include_all_bids_sheet"]:
                every = report.column_keys(common, company=True, location=True)
                by_key = {c[0]: c for c in report.COLUMNS}
                spec = _spec(
                    pattern=patterns["master"], name="All Bids", title=_texts("All Bids", when), headers=[by_key[k][1] for k in every], kinds=[by_key[k][3] for k in every],
                    widths=[float(by_key[k][2]) for k in every], top=_TOP, hidden=False, best=common["columns"].get("highlight_best_bids", True),
                )
                parts.append(_rows(_one(spark), book, F.lit(_ALL), F.lit(0), _TOP, spec=spec))
                parts.append(_rows(all_rows, book, F.lit(_ALL), F.col("place"), _TOP, cells=_bid_cells(_texts(*every))))
    if "per_company" in modes:
        keys = report.column_keys(common, company=False, location=True)
        sheets = _company_sheets(of_all, [], _own_sheets(spark, doc, common, location=True), keys, common)
        sheets = sheets.withColumns({"book": F.concat(F.lit("2|"), F.lpad(F.col("rank").cast("string"), 10, "0")), "sheet": F.lit(_COMPANIES)})
        parts += _bid_sheets(sheets, sheets_of(of_all, sheets, ["company_id", "company_name"]), name=F.col("company_name"), title=F.array("company_name", F.lit("Cash bids"), F.lit(when)), pattern=patterns["per_company"])
    if "per_commodity" in modes:
        by_place = dict(common, group_by="location")
        keys = report.column_keys(by_place, company=False, location=True)
        # A company's own settings don't hold for books of grains, and none of their sheets has charts.
        rows = kept("grains", report.grain_rows(bids, by_place, today))
        none = spark.createDataFrame([], "company string, keys array<string>, charts string, best boolean, linked boolean")
        sheets = _company_sheets(rows, ["commodity"], none, keys, dict(by_place, charts="none"))
        sheets = sheets.withColumns({"book": F.concat(F.lit("3|"), "commodity"), "sheet": F.col("rank") + _COMPANIES})
        title = F.array(F.concat("company_name", F.lit(" - "), "commodity"), F.concat("commodity", F.lit(" cash bids")), F.lit(when))
        parts += _bid_sheets(sheets, sheets_of(rows, sheets, ["commodity", "company_id", "company_name"]), name=F.col("company_name"), title=title, pattern=patterns["per_commodity"], commodity=F.col("commodity"))
    if not parts:
        return None
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _shared(spark: SparkSession) -> str:
    """Where tasks leave parts: the folder that the cluster names, or a new one in the temporary folder of a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="millrace-")


def build_reports(bids: DataFrame, health: DataFrame, doc: dict, folder: Path, run_id: int, now: datetime) -> list[Path]:
    """bids: query_bids of the run. health: page_health of the run. Returns the workbooks, the one of all companies first.

    Rows of all workbooks come from one plan and are written by tasks; how many companies, grains or sheets there are doesn't
    change the number of jobs, and the driver holds of each sheet what it is and where its parts lie.
    """
    spark = bids.sparkSession
    shared = _shared(spark)
    rows = report_rows_of_all(bids, health, doc, now, shared)
    if rows is None:
        return []
    folder.mkdir(parents=True, exist_ok=True)
    spark.dataSource.register(Workbooks)
    receipt = folder / f".written-{uuid.uuid4().hex}.json"
    key = ["book", "sheet", "place"]
    tokens = {"date": f"{now:%Y-%m-%d}", "time": f"{now:%H%M}", "scan_id": str(run_id)}
    options = {"parts": shared, "receipt": str(receipt), "tokens": json.dumps(tokens), "decimals": json.dumps(S.effective(doc)["decimals"])}
    rows.repartitionByRange(*key).sortWithinPartitions(*key).write.format("xlsx").mode("append").options(**options).save(str(folder))
    written = [Path(p) for p in json.loads(receipt.read_text())]
    receipt.unlink()
    if doc["output"]["archive"]["enabled"]:
        archive_old(folder, doc["output"]["archive"]["keep_latest"], f"{now:%Y-%m}")
    return written
