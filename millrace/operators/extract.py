"""From grids of untyped cells to typed bids: scoring, column roles, rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import vocabulary as V
from millrace.functions import dates, hashing, notation
from millrace.functions.columns import bound, no_notes, stripped
from millrace.sources.html_grids import html_read

LOW_SCORE, ACCEPT_SCORE = 4, 8
GRID = ["page_id", "grid"]


def shape_role(share: dict[str, Column]) -> Column:
    """struct<role, conf> from the shares of a column's cells that have each shape; the most specific shapes come first."""
    order = [
        ("eighths", 0.6, "futures_price"), ("change_8ths", 0.6, "change"), ("fut_month", 0.5, "futures_month"),
        ("date_range", 0.5, "delivery_period"), ("mdy", 0.6, "last_updated"), ("commodity", 0.6, "commodity"),
        ("basis", 0.7, "basis"), ("price", 0.7, "cash_price"), ("price_cents", 0.7, "cash_price"), ("month_in", 0.6, "delivery_period"),
    ]
    out = F.struct(F.lit(None).cast("string").alias("role"), F.lit(0.0).alias("conf"))
    for shape, least, role in reversed(order):
        out = F.when(share[shape] >= least, F.struct(F.lit(role).alias("role"), share[shape].alias("conf"))).otherwise(out)
    return out


SHAPES = V.SHAPES


def column_shapes(cells: DataFrame) -> DataFrame:
    """One row per column of a grid: the share of its non-empty cells with each shape. Partial sums before any shuffle."""
    filled = F.col("cell") != ""
    share = lambda p: F.coalesce(F.avg(F.when(filled, F.regexp_like("cell", F.lit(p)).cast("double"))), F.lit(0.0))
    return cells.groupBy(*GRID, "col").agg(*(share(p).alias(n) for n, p in SHAPES.items()))


#: Shapes that take a whole cell, of which it has one at most, by the characters that such a cell starts with.
_WHOLE = {"$0123456789": ["price", "price_cents", "eighths", "mdy"], "+-": ["basis", "change_8ths"]}
_BIT = {n: 1 << k for k, n in enumerate(SHAPES)}


def shape_bits(cell: Column) -> Column:
    """int: a bit for each shape of a non-empty cell without blanks at its ends. Its first character and what it has already
    leave few patterns to be tried."""
    has = lambda n: F.regexp_like(cell, F.lit(SHAPES[n]))
    bit = lambda n: F.when(has(n), _BIT[n]).otherwise(0)
    month = F.when(has("month_in"), F.lit(_BIT["month_in"]) + bit("month") + bit("date_range")).otherwise(0)
    out = F.when(F.lit(False), 0)
    for start, names in _WHOLE.items():
        of_start = F.when(F.lit(False), 0)
        for n in names:
            of_start = of_start.when(has(n), _BIT[n])
        out = out.when(F.substring(cell, 1, 1).isin(list(start)), of_start.otherwise(bit("month_in")))
    return out.otherwise(month + bit("fut_month") + bit("commodity"))


def shape_shares(cells: Column) -> Column:
    """struct with the share of a column's non-empty cells that have each shape; 0 if there are none."""
    share = lambda bits, n: F.coalesce(F.size(F.filter(bits, lambda x: x.bitwiseAND(F.lit(_BIT[n])) != 0)) / F.nullif(F.size(bits), F.lit(0)), F.lit(0.0))
    return bound(F.transform(cells, shape_bits), lambda bits: F.struct(*(share(bits, n).alias(n) for n in SHAPES)))


def vague(header: Column) -> Column:
    """Whether a header text has a word that could mean several things."""
    words = F.split(F.regexp_replace(F.lower(header), "[^a-z ]", ""), r"\s+")
    return F.arrays_overlap(words, F.array(*map(F.lit, V.AMBIGUOUS_HEADER_WORDS)))


def grid_score(shapes: Column, header_roles: Column, near: Column) -> Column:
    """Points for columns that look like prices, basis, deliveries and so on, for a grain's name nearby and for two header
    roles or more; fewer than two columns are no grid of bids."""

    def some(points: int, holds: Callable[[Column], Column]) -> Column:
        return F.when(F.exists(shapes, holds), points).otherwise(0)

    total = (
        some(4, lambda c: (c["price"] >= 0.6) | (c["price_cents"] >= 0.6)) + some(4, lambda c: c["basis"] >= 0.6) + some(3, lambda c: c["eighths"] > 0)
        + some(3, lambda c: (c["date_range"] >= 0.5) | (c["month"] >= 0.5)) + some(3, lambda c: c["fut_month"] >= 0.5) + some(1, lambda c: c["mdy"] >= 0.6)
    )
    roles = F.size(F.array_distinct(F.filter(F.coalesce(header_roles, no_notes()), lambda r: r.isNotNull())))
    total = total + F.when(F.regexp_like(near, F.lit(V.COMMODITY_WORD)), 3).otherwise(0) + F.when(roles >= 2, 4).otherwise(0)
    return F.when(F.size(shapes) < 2, -99).otherwise(total).cast("double")


def column_roles(shapes: Column, header: Column, header_roles: Column, cells: Column) -> Column:
    """array<string>: the role of each column, or null. A role is given once in a grid, to the first column.

    Headers come first, unless a vague word in them is contradicted by the column's shape; then shapes. Of two signed
    columns the one that agrees with cash less futures is the basis and the next one the change; without such a one,
    that with the larger upper median.
    """
    first_of = lambda xs, i: F.array_position(xs, F.get(xs, i)) == i + 1  # noqa: E731  its first place among equals
    shaped = F.transform(shapes, lambda c: shape_role({n: c[n] for n in SHAPES}))

    def by_header(guess: Column) -> Column:
        def of(g: Column, i: Column) -> Column:
            said = F.get(header_roles, i)
            contradicted = vague(F.get(header, i)) & (g["conf"] >= 0.5) & (F.coalesce(g["role"], F.lit("")) != said)
            return F.when(~F.coalesce(contradicted, F.lit(False)), said)

        return F.transform(guess, of)

    def settled(guess: Column, said: Column) -> Column:
        named = F.transform(said, lambda r, i: F.when(first_of(said, i), r))

        def with_shapes(named: Column) -> Column:
            taken = F.filter(named, lambda r: r.isNotNull())
            open_ = F.transform(guess, lambda g, i: F.when(F.get(named, i).isNull() & ~F.array_contains(taken, F.coalesce(g["role"], F.lit(""))), g["role"]))
            return bound(open_, lambda xs: F.transform(named, lambda r, i: F.coalesce(r, F.when(first_of(xs, i), F.get(xs, i)))))

        return bound(named, with_shapes)

    roles = bound(shaped, lambda guess: bound(by_header(guess), lambda said: settled(guess, said)))
    signed = F.filter(
        F.transform(shapes, lambda c, i: F.when((c["basis"] >= 0.7) | (c["change_8ths"] >= 0.6), i)), lambda i: i.isNotNull()
    )
    both = F.array(F.lit("basis"), F.lit("change"))

    def told_apart(roles: Column, signed: Column) -> Column:
        clear = (F.size(signed) < 2) | (F.size(F.array_intersect(roles, both)) == 2)
        ranked = bound(
            _signed_columns(roles, signed, cells),
            lambda ranks: F.transform(
                roles, lambda r, i: F.when(i == F.get(ranks, F.lit(0)), "basis").when(i == F.get(ranks, F.lit(1)), "change").when(~r.isin("basis", "change"), r)
            ),
        )
        return F.when(clear, roles).otherwise(ranked)

    return bound(roles, lambda r: bound(signed, lambda s: told_apart(r, s)))


def _signed_columns(roles: Column, signed: Column, cells: Column) -> Column:
    """Places of signed columns: that of the basis, that of the change, then others."""
    price_at = lambda row, role: notation.price(F.get(row, (F.array_position(roles, role) - 1).cast("int")))["value"]
    sides = F.transform(cells, lambda row: (price_at(row, "cash_price") - price_at(row, "futures_price")))

    def judged(side: Column, i: Column) -> Column:
        values = F.transform(cells, lambda row: notation.basis(F.get(row, i))["value"])

        def of(v: Column) -> Column:
            fits = F.filter(F.zip_with(side, v, lambda s, x: F.abs(s - x) <= 0.02), lambda f: f.isNotNull())
            sizes = F.array_sort(F.transform(F.filter(v, lambda x: x.isNotNull()), lambda x: F.abs(x)))
            agrees = F.size(F.filter(fits, lambda f: f)) >= 0.7 * F.size(fits)
            median = F.coalesce(F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")), F.lit(0.0))
            return F.struct((~(agrees & (F.size(fits) > 0))).alias("apart"), median.alias("median"), i.alias("i"))

        return bound(values, of)

    def ordered(found: Column) -> Column:
        best = F.array_min(F.transform(F.filter(found, lambda x: ~x["apart"]), lambda x: x["i"]))
        by_fit = F.transform(found, lambda x: F.struct((x["i"] != best).cast("double").alias("k"), x["i"].alias("i")))
        by_size = F.transform(found, lambda x: F.struct((-x["median"]).alias("k"), x["i"].alias("i")))
        return F.transform(F.array_sort(F.when(best.isNotNull(), by_fit).otherwise(by_size)), lambda x: x["i"])

    return bound(sides, lambda side: bound(F.transform(signed, lambda i: judged(side, i)), ordered))


def typed_rows(rows: DataFrame) -> DataFrame:
    """From verbatim columns named as roles (plus commodity_ctx and ref_date): each with its value beside it, notes and confidence.

    Rows without any number are dropped: they are repeated headers and the like.
    """
    raw = lambda role: stripped(F.col(role))
    out = rows.withColumns(
        {
            "commodity_raw": F.when(raw("commodity") != "", raw("commodity")).otherwise(F.coalesce("commodity_ctx", F.lit(""))),
            "delivery_raw": raw("delivery_period"), "cash_price_raw": raw("cash_price"), "basis_raw": raw("basis"), "futures_raw": raw("futures_price"),
            "futures_month_raw": raw("futures_month"), "change_raw": raw("change"), "last_update_raw": raw("last_updated"),
        }
    ).drop("commodity", "delivery_period", "cash_price", "basis", "futures_price", "futures_month", "change", "last_updated")
    read = F.struct(
        notation.grain(F.col("commodity_raw")).alias("commodity"), notation.price(F.col("cash_price_raw")).alias("p"), notation.basis(F.col("basis_raw")).alias("b"),
        notation.price(F.col("futures_raw")).alias("f"), notation.change(F.col("change_raw")).alias("change"),
        notation.futures_month(F.col("futures_month_raw"), F.col("ref_date")).alias("futures_month"), dates.last_update(F.col("last_update_raw")).alias("last_update"),
    )
    # a row is read and dropped in one generator: a filter above it would be pushed below, and read each row again
    some = lambda x: F.coalesce(x["p"]["value"], x["b"]["value"], x["f"]["value"], x["change"]).isNotNull()
    out = out.select("*", F.inline(F.filter(F.array(read), some))).withColumn("d", dates.delivery(F.col("delivery_raw"), F.col("ref_date"), F.col("commodity")))
    out = out.withColumns(
        {"cash_price": F.col("p.value"), "basis": F.col("b.value"), "futures_price": F.col("f.value"), "delivery_start": F.col("d.start"), "delivery_end": F.col("d.end"),
         "notes": F.concat("p.notes", "b.notes", "f.notes", "d.notes")}
    )
    odd = F.size(F.array_distinct(F.filter("notes", lambda n: n.endswith("_inferred") | n.endswith("_assumed") | n.endswith("_cents"))))
    start = F.when(F.col("cash_price").isNull() & F.col("basis").isNull(), 0.4).otherwise(1.0) - odd * 0.1
    adds_up = F.abs(F.col("cash_price") - (F.col("futures_price") + F.col("basis"))) <= 0.03
    confidence = F.when(adds_up, F.least(F.lit(1.0), start + 0.1)).otherwise(start)
    unknown = F.when(F.col("commodity").isNull() & (F.col("commodity_raw") != ""), F.array(F.lit("commodity_unrecognized"))).otherwise(no_notes())
    return out.withColumns({"confidence": F.greatest(F.lit(0.1), F.round(confidence, 3)), "notes": F.concat("notes", unknown)}).drop("p", "b", "f", "d")


def with_hashes(bids: DataFrame, *, page: list[str], ordinal: list[str]) -> DataFrame:
    """row_hash (identity) and value_hash; the nth repeat of an identity on a page gets a hash of its own and a note."""
    key = hashing.delivery_key(F.col("delivery_start"), F.col("delivery_end"), F.col("delivery_raw"), F.col("delivery_raw"))
    base = hashing.identity_hash(*map(F.col, ("site_id", "location_label", "commodity", "commodity_raw")), key, F.col("futures_month"))
    out = bids.withColumn("base", base)
    nth = F.row_number().over(Window.partitionBy(*page, "base").orderBy(*ordinal)) - 1
    out = out.withColumn("nth", nth)
    return out.withColumns(
        {
            "row_hash": F.when(F.col("nth") == 0, F.col("base")).otherwise(hashing.digest(F.col("base"), F.col("nth"))),
            "value_hash": hashing.value_hash(*map(F.col, ("cash_price", "basis", "futures_price", "change"))),
            "notes": F.when(F.col("nth") > 0, F.concat("notes", F.array(F.lit("duplicate_identity_disambiguated")))).otherwise(F.col("notes")),
        }
    ).drop("base", "nth")


def graded(read: DataFrame) -> DataFrame:
    """One row per grid of a page (one with a null grid for a page without any): its cells, score, whether it is `chosen`
    (it has enough points and lies in no other such grid of its page), and then the roles of its columns.

    A grid is one row of arrays, worked out in place; rows move once, to meet those of their page. Cells come without blanks
    at their ends, and with the shapes of their columns, but where a cell is beyond ASCII.
    """
    rows = read.select("page_id", "as_of_text", "crashed", F.inline_outer("grids"))
    filled = lambda cells: F.transform(  # noqa: E731  the non-empty cells of each column
        F.sequence(F.lit(0), F.array_max(F.transform(cells, lambda row: F.size(row))) - 1),
        lambda i: F.filter(F.transform(cells, lambda row: F.get(row, i)), lambda x: x != ""),
    )
    near = F.concat_ws(" ", "context", "around")

    def measured(shapes: Column) -> Column:
        score = grid_score(shapes, F.col("header_roles"), near)
        return F.struct(score.alias("score"), F.when(score >= LOW_SCORE, shapes).alias("shapes"))

    shapes = F.coalesce("shapes", F.transform(filled(F.col("rows")), shape_shares))
    found = rows.withColumn("g", F.when(F.col("grid").isNotNull(), bound(shapes, measured)))
    found = found.select("page_id", "as_of_text", "crashed", "grid", "context", "anchor", "last", "header", "header_roles", F.col("rows").alias("cells"), "g.*")
    # cells are few bytes and much work: a number that is named keeps all tasks, where others would be put together by bytes
    found = found.repartition(int(read.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")
    good = F.col("score") >= LOW_SCORE
    # elements lie in each other or apart: what began before and ends after this one's place holds it
    before = Window.partitionBy("page_id").orderBy("anchor").rangeBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.max(F.when(good, F.col("last"))).over(before) >= F.col("anchor"), F.lit(False))
    found = found.withColumn("chosen", F.coalesce(good & ~held, F.lit(False)))
    roles = F.when(F.col("chosen"), column_roles(F.col("shapes"), F.col("header"), F.col("header_roles"), F.col("cells")))
    return found.withColumn("roles", roles).drop("anchor", "last", "header", "header_roles", "shapes")


def extract_bids(pages: DataFrame, ref_date: Column, *, id_col: str = "page_id", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(bids, page results) of pages. `ref_date` stands in for a page's date where the page doesn't say one.

    Bids keep page_id, grid and row. Page results: page_id, as_of_text, as_of_date, score, n_rows, confidence, crashed, flags
    (SCAN_INTERNAL_ERROR, NO_BID_DATA, PARTIAL_COLUMNS or LOW_CONFIDENCE_EXTRACTION), roles (the columns' roles in its best
    grid, as JSON).
    """
    return bids_of(html_read(pages, id_col=id_col, html_col=html_col), ref_date)


def bids_of(read: DataFrame, ref_date: Column, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """As extract_bids, from what html_read gives. If both results are wanted, `keep` stores what they share and gives it back,
    so that it is planned and worked out once."""
    grids = keep(graded(read))
    priced = F.arrays_overlap("roles", F.array(F.lit("cash_price"), F.lit("basis")))
    cell = lambda role: F.get("cells", (F.array_position("roles", role) - 1).cast("int"))
    # what the rows of a grid share is worked out before they are taken apart
    named = F.when(F.regexp_like("context", F.lit(V.COMMODITY_WORD)), F.col("context"))
    told = grids.where("chosen").withColumns({"as_of_date": dates.as_of(F.col("as_of_text")), "commodity_ctx": named})
    shared = ["page_id", "grid", "score", "context", "as_of_text", "as_of_date", "commodity_ctx"]
    # a filter by roles would be pushed below them, and find them twice
    rows = told.select(*shared, "roles", F.posexplode(F.when(priced, F.col("cells"))).alias("row", "cells"))
    rows = rows.select(*shared, "row", *(cell(r).alias(r) for r in V.ROLES if r not in ("notes", "location")))
    bids = typed_rows(rows.withColumn("ref_date", F.coalesce("as_of_date", ref_date)))
    bids = bids.withColumn("confidence", F.when(F.col("score") < ACCEPT_SCORE, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")))
    bids = keep(bids)
    found = bids.groupBy("page_id").agg(
        F.count("*").alias("n_rows"), F.least(F.lit(1.0), F.avg("confidence")).alias("confidence"), F.bool_or(F.col("score") < ACCEPT_SCORE).alias("unsure")
    )
    flag = (
        F.when(F.col("crashed"), F.array(F.lit("SCAN_INTERNAL_ERROR")))
        .when(~F.col("chosen"), F.array(F.lit("NO_BID_DATA")))
        .when(F.coalesce("n_rows", F.lit(0)) == 0, F.array(F.lit("PARTIAL_COLUMNS")))
        .when(F.col("unsure"), F.array(F.lit("LOW_CONFIDENCE_EXTRACTION")))
        .otherwise(no_notes())
    )
    of_page = grids.groupBy("page_id").agg(
        F.first("as_of_text").alias("as_of_text"), F.max("score").alias("score"), F.bool_or("chosen").alias("chosen"), F.first("crashed").alias("crashed"),
        F.to_json(F.max_by(F.when(F.col("chosen"), F.col("roles")), F.when(F.col("chosen"), F.struct("score", -F.col("grid"))))).alias("roles"),
    )
    results = of_page.join(found, "page_id", "left").select(
        "page_id", "as_of_text", dates.as_of(F.col("as_of_text")).alias("as_of_date"), "score", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "crashed", flag.alias("flags"), "roles",
    )
    return bids.drop("context", "commodity_ctx", "ref_date", "as_of_text"), results
