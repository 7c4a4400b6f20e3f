"""Rows of reports: filters, order, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import notes_text

#: Key, header, width, kind.
COLUMNS = [
    ("company", "Company", 22, "text"), ("location", "Location", 16, "text"), ("commodity", "Commodity", 15, "text"), ("delivery", "Delivery", 20, "text"),
    ("start", "Starts", 11, "date"), ("end", "Ends", 11, "date"), ("cash", "Cash Bid", 12, "cash"), ("basis", "Basis", 10, "basis"),
    ("fut_month", "Futures Month", 14, "text"), ("futures", "Futures", 11, "futures"), ("change", "Change", 10, "change"), ("asof", "Bids As Of", 12, "date"),
    ("notes", "Notes", 34, "wrap"),
]


def in_horizon(start: Column, today: Column, months: int) -> Column:
    """Deliveries that start within so many months of 31 days, or at an unknown date; 0 months is no limit."""
    return F.lit(True) if not months else start.isNull() | (start <= F.date_add(today, 31 * months))


def order_keys(group_by: str, sort_by: str) -> list[Column]:
    """What rows are sorted by: the group, the key, then company, grain and delivery, so that ties keep the base order."""
    filled = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("zzz"))
    groups = {"commodity": filled("commodity"), "location": filled("site_label"), "company": filled("company_name")}
    keys = {
        "delivery_start": F.coalesce("delivery_start", F.to_date(F.lit("2100-01-01"))), "commodity": filled("commodity"), "location": filled("site_label"),
        "cash_desc": F.when(F.coalesce("cash_price", F.lit(0.0)) == 0, 999.0).otherwise(-F.col("cash_price")),
    }
    base = [F.col(c) for c in ("company_name", "commodity", "delivery_start")]  # nulls come first
    return [groups.get(group_by, F.lit("")), keys.get(sort_by, keys["delivery_start"]), *base]


def report_rows(bids: DataFrame, effective: dict, today: Column) -> DataFrame:
    """Bids that the settings select, with `place` (their order), `breaks` (a new group starts) and `shaded` (every other row)."""
    rows = bids
    if effective.get("commodities"):
        rows = rows.where(F.col("commodity").isin(effective["commodities"]))
    if effective.get("locations"):
        rows = rows.where(F.coalesce("site_label", F.lit("")).isin(effective["locations"]))
    rows = rows.where(in_horizon(F.col("delivery_start"), today, int(effective.get("horizon_months", 0))))
    group_by = effective.get("group_by", "commodity")
    keys = [*order_keys(group_by, effective.get("sort_by", "delivery_start")), F.col("bid_id")]
    group = {"commodity": "commodity", "location": "site_label", "company": "company_name"}.get(group_by)
    return numbered(rows, keys, group)


def company_rows(bids: DataFrame, own: DataFrame, common: dict, today: Column) -> DataFrame:
    """As report_rows, for the sheets of all companies in one plan: place, breaks and shaded are those within a company.

    own(company_id, commodities, locations, horizon_months, group_by, sort_by): what holds for companies that have settings
    of their own (see settings.overrides); `common` holds for others. What rows are kept and sorted by is chosen row by row.
    """
    of = ("commodities", "locations", "horizon_months", "group_by", "sort_by")
    said = {
        "commodities": F.array(*map(F.lit, common.get("commodities") or [])).cast("array<string>"), "locations": F.array(*map(F.lit, common.get("locations") or [])).cast("array<string>"),
        "horizon_months": F.lit(int(common.get("horizon_months", 0))), "group_by": F.lit(common.get("group_by", "commodity")), "sort_by": F.lit(common.get("sort_by", "delivery_start")),
    }
    theirs = own.select(F.col("company_id").cast("string").alias("__company"), F.struct(*of).alias("__own"))
    rows = bids.withColumn("__company", F.coalesce(F.col("company_id").cast("string"), F.lit(""))).join(theirs, "__company", "left")
    rows = rows.withColumn("__s", F.struct(*(F.when(F.col("__own").isNotNull(), F.col("__own")[k]).otherwise(said[k]).alias(k) for k in of)))
    s = F.col("__s")
    within = lambda chosen, value: (F.size(chosen) == 0) | F.array_contains(chosen, value)
    rows = rows.where(within(s["commodities"], F.coalesce("commodity", F.lit(""))) & within(s["locations"], F.coalesce("site_label", F.lit(""))))
    rows = rows.where((s["horizon_months"] == 0) | F.col("delivery_start").isNull() | (F.col("delivery_start") <= F.date_add(today, s["horizon_months"] * 31)))
    name = F.when(s["group_by"] == "commodity", F.col("commodity")).when(s["group_by"] == "location", F.col("site_label")).when(s["group_by"] == "company", F.col("company_name"))
    filled = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("zzz"))
    by = lambda *kinds: s["sort_by"].isin(*kinds)  # noqa: E731  keys of other kinds are null in all rows of a company
    keys = [
        F.col("__company"), F.when(s["group_by"] != "none", filled(name)), F.when(by("commodity"), filled(F.col("commodity"))).when(by("location"), filled(F.col("site_label"))),
        F.when(by("cash_desc"), F.when(F.coalesce("cash_price", F.lit(0.0)) == 0, 999.0).otherwise(-F.col("cash_price"))),
        F.when(by("delivery_start"), F.coalesce("delivery_start", F.to_date(F.lit("2100-01-01")))), *(F.col(c) for c in ("company_name", "commodity", "delivery_start", "bid_id")),
    ]
    placed = numbered(rows.withColumn("__name", F.struct("__company", name.alias("name"))).drop("__own"), keys, "__name")
    return _within(placed, ["__company"]).drop("__company", "__name", "__s")


def grain_rows(bids: DataFrame, common: dict, today: Column) -> DataFrame:
    """As report_rows, for the sheets of all grains and companies in one plan: place, breaks and shaded are those within a
    grain's rows of a company. Bids without a grain are on none."""
    rows = bids.where(F.col("commodity").isNotNull())
    if common.get("commodities"):
        rows = rows.where(F.col("commodity").isin(common["commodities"]))
    if common.get("locations"):
        rows = rows.where(F.coalesce("site_label", F.lit("")).isin(common["locations"]))
    rows = rows.where(in_horizon(F.col("delivery_start"), today, int(common.get("horizon_months", 0))))
    group = {"commodity": "commodity", "location": "site_label", "company": "company_name"}.get(common.get("group_by", "location"))
    sheet = [F.col("commodity").alias("grain"), F.coalesce(F.col("company_id").cast("string"), F.lit("")).alias("company")]
    rows = rows.withColumn("__sheet", F.struct(*sheet)).withColumn("__name", F.struct("__sheet", (F.col(group) if group else F.lit(None)).alias("name")))
    keys = [F.col("__sheet"), *order_keys(common.get("group_by", "location"), common.get("sort_by", "delivery_start")), F.col("bid_id")]
    return _within(numbered(rows, keys, "__name"), ["__sheet"]).drop("__sheet", "__name")


def _within(placed: DataFrame, sheet: list[str]) -> DataFrame:
    """Places of numbered rows counted anew within `sheet`, whose rows follow each other."""
    first = placed.groupBy(*sheet).agg((F.min("place") - 1).alias("__first"))
    out = placed.join(first, sheet).withColumn("place", F.col("place") - F.col("__first"))
    return out.withColumns({"breaks": F.col("breaks") & (F.col("place") > 1), "shaded": F.col("place") % 2 == 0}).drop("__first")


def numbered(rows: DataFrame, keys: list[Column], group: str | None) -> DataFrame:
    """Adds place (from 1, in the order of `keys`), breaks (the column `group` differs from the row before) and shaded.

    Rows are dealt by ranges of all keys, which spreads a group or a sort value that most rows have over all tasks, and
    sorted there. A partition's rows and its last name, a row each, tell where the next one's places begin and what stood
    above its first row. The ranges are kept until the session's cache is cleared: they come from a sample, and places hold
    for one and the same dealing only (a lost block is dealt by the same ranges).
    """
    order = [F.col(f"__k{i}").asc_nulls_first() for i in range(len(keys))]
    dealt = rows.withColumns({f"__k{i}": k for i, k in enumerate(keys)}).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.drop(*(f"__k{i}" for i in range(len(keys)))).withColumn("__id", F.monotonically_increasing_id())
    dealt = dealt.withColumn("__part", F.shiftright("__id", 33)).persist()  # the id's upper bits are the partition, the lower ones the row
    name = F.col(group) if group else F.lit(None).cast("string")
    said = lambda: F.struct(name.alias("name"))
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__n"), F.max_by(said(), "__id").alias("__last"))
    before = Window.orderBy("__part")  # over a row for each partition
    parts = parts.select("__part", (F.sum("__n").over(before) - F.col("__n")).alias("__before"), F.lag("__last").over(before)["name"].alias("__over"))
    above = F.lag(said()).over(Window.partitionBy("__part").orderBy("__id"))
    out = dealt.withColumn("__above", above).join(F.broadcast(parts), "__part")
    place = (F.col("__before") + F.col("__id") - F.shiftleft("__part", 33) + 1).cast("int")
    last = F.when(F.col("__above").isNotNull(), F.col("__above.name")).otherwise(F.col("__over"))
    breaks = ~name.eqNullSafe(last) & (place > 1) if group else F.lit(False)
    out = out.withColumns({"place": place, "breaks": breaks})
    return out.withColumn("shaded", F.col("place") % 2 == 0).drop("__id", "__part", "__above", "__before", "__over")


def column_keys(effective: dict, *, company: bool, location: bool) -> list[str]:
    wanted = effective.get("columns", {})
    off = set()
    if not company:
        off.add("company")
    if not location:
        off.add("location")
    if not (company or location):
        off.add("asof")
    for switch, keys in (("include_delivery_dates", ("start", "end")), ("include_futures", ("fut_month", "futures")), ("include_change", ("change",)), ("include_flags", ("notes",))):
        if not wanted.get(switch, True):
            off.update(keys)
    return [key for key, *_ in COLUMNS if key not in off]


def shown_values() -> dict[str, Column]:
    """What a sheet shows under the keys of COLUMNS; raw texts stand in where a value wasn't read."""
    either = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    return {
        "company": F.col("company_name"), "location": F.col("site_label"), "commodity": either("commodity", F.col("commodity_raw")),
        "delivery": either("delivery_raw", F.lit(None)), "start": F.col("delivery_start"), "end": F.col("delivery_end"), "cash": F.col("cash_price"),
        "basis": F.col("basis"), "fut_month": either("futures_month", F.col("futures_month_raw")), "futures": F.col("futures_price"), "change": F.col("change"),
        "asof": F.col("page_as_of"), "notes": notes_text(F.col("notes")),
    }


def shown(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of a sheet under their keys."""
    value = shown_values()
    return rows.select("place", "breaks", "shaded", *(value[k].alias(k) for k in keys))
