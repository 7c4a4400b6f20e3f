"""Parsers of trade notation, over texts composed from the driver's numbers and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, notation
from millrace.operators.extract import SHAPES, column_shapes, shape_role
from millrace.plans.registry import query
from millrace.session import table
from millrace.vocabulary import COMMODITY_ALIASES


@query(
    "q07_eighths",
    """SELECT l_orderkey, l_linenumber, l_partkey, round((CAST(floor(l_quantity * 10) AS BIGINT) + (l_orderkey % 8) / 8.0) / 100.0, 6) AS price FROM lineitem""",
)
def q07_eighths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.floor(F.col("l_quantity") * 10).cast("string"), F.lit("-"), (F.col("l_orderkey") % 8).cast("string"), F.lit("s"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(notation.price(text)["value"], 6).alias("price"))


@query(
    "q09_infer_year",
    """SELECT o_orderkey, 1998 + CASE WHEN coalesce(try_cast('1998-' || strftime(o_orderdate, '%m-%d') AS DATE), DATE '1998-02-01') < DATE '1998-06-15' - 45 THEN 1 ELSE 0 END AS year
       FROM orders""",
)
def q09_infer_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.to_date(F.lit("1998-06-15"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.infer_year(F.month("o_orderdate"), F.dayofmonth("o_orderdate"), ref).alias("year"))


@query(
    "q10_safe_date",
    """SELECT o_orderkey, CAST(try_cast(strftime(o_orderdate, '%Y-%m-') || CASE WHEN month(o_orderdate) = 2 THEN '29' WHEN month(o_orderdate) IN (4, 6, 9, 11) THEN '30' ELSE '31' END AS DATE) AS VARCHAR) AS last
       FROM orders""",
)
def q10_safe_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = dates.safe_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(31))
    return table(spark, sf_dir, "orders").select("o_orderkey", last.cast("string").alias("last"))


_ALIASES = [(alias, name) for name, aliases in COMMODITY_ALIASES.items() for alias in aliases if "#" not in alias and "%" not in alias and not alias.startswith("no ")]
_LABELS = [alias.title() for alias, _ in _ALIASES]
_NAMES = [notation_name for _, notation_name in _ALIASES]


@query(
    "q25_canon_alias",
    "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE ([" + ", ".join(f"'{n}'" for n in _NAMES) + f"])[CAST(p_partkey % {len(_NAMES)} AS INT) + 1] END AS commodity FROM part",
)
def q25_canon_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    label = F.get(F.array(*map(F.lit, _LABELS)), (k % len(_LABELS)).cast("int"))
    text = F.when(k % 9 == 0, "Unobtanium").when(k % 2 == 0, F.concat(F.lit("US #2 "), label)).otherwise(F.concat(F.lit("  "), label, F.lit(" (new)")))
    return table(spark, sf_dir, "part").select("p_partkey", notation.grain(text).alias("commodity"))


_KINDS = """CASE l_orderkey % 6 WHEN 0 THEN round(l_quantity / 4, 4) WHEN 1 THEN round(CAST(floor(l_quantity * 10 + 51) AS BIGINT) / 100.0, 6) WHEN 2 THEN NULL
            WHEN 3 THEN round(l_quantity / 4, 4) WHEN 4 THEN round((CAST(floor(l_quantity * 8) AS BIGINT) + 0.5) / 100, 6) ELSE NULL END"""


@query(
    "q29_price",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, round({_KINDS}, 6) AS price, CASE WHEN l_orderkey % 6 = 1 THEN 'unit_assumed_cents' ELSE '' END AS notes FROM lineitem""",
)
def q29_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q = F.col("l_orderkey") % 6, F.col("l_quantity")
    plain = F.format_number(q / 4, 4)
    text = (
        F.when(k == 0, F.concat(F.lit(" $"), plain)).when(k == 1, F.format_number(F.floor(q * 10 + 51), 0)).when(k == 2, "N/A").when(k == 3, F.concat(plain, F.lit(" /bu")))
        .when(k == 4, F.concat(F.floor(q * 8).cast("string"), F.lit("-4"))).otherwise("Closed")
    )
    read = notation.price(text)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(read["value"], 6).alias("price"), F.array_join(read["notes"], ",").alias("notes")
    )


@query(
    "q29_basis",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_orderkey % 4 WHEN 0 THEN round(-l_discount, 4) + 0.0 WHEN 1 THEN round(-(CAST(l_quantity AS INT) + 2) / 100.0, 6) WHEN 2 THEN NULL ELSE round(l_tax, 4) END AS basis,
       CASE l_orderkey % 4 WHEN 1 THEN 'unit_assumed_cents' WHEN 2 THEN 'basis_out_of_range' ELSE '' END AS notes FROM lineitem""",
)
def q29_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("-"), F.format_number("l_discount", 4))).when(k == 1, F.concat(F.lit("-"), (F.col("l_quantity").cast("int") + 2).cast("string")))
        .when(k == 2, "-9.99").otherwise(F.concat(F.lit("+"), F.format_number("l_tax", 4)))
    )
    read = notation.basis(text)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.round(read["value"], 6) + F.lit(0.0)).alias("basis"), F.array_join(read["notes"], ",").alias("notes")
    )


@query(
    "q29_change",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN NULL WHEN 2 THEN round((CAST(l_quantity AS INT) + (l_partkey % 8) / 8.0) / 100.0, 6) ELSE round(-l_discount, 4) + 0.0 END AS change
       FROM lineitem""",
)
def q29_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") % 4
    text = (
        F.when(k == 0, "Unch").when(k == 1, " ")
        .when(k == 2, F.concat(F.lit("+"), F.col("l_quantity").cast("int").cast("string"), F.lit("-"), (F.col("l_partkey") % 8).cast("string")))
        .otherwise(F.concat(F.lit("-"), F.format_number("l_discount", 4)))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", notation.change(text).alias("change"))


@query(
    "q30_delivery",
    """WITH d AS (SELECT o_orderkey, o_orderkey % 5 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
       SELECT o_orderkey, CAST(CASE k WHEN 4 THEN NULL WHEN 0 THEN d WHEN 2 THEN d ELSE date_trunc('month', d) END AS DATE)::VARCHAR AS "start",
              CASE k WHEN 4 THEN NULL WHEN 0 THEN CAST(d + 20 AS VARCHAR)
                     WHEN 1 THEN CASE WHEN month(d) = 2 AND year(d) % 4 <> 0 THEN NULL ELSE CAST(last_day(d) AS VARCHAR) END
                     WHEN 2 THEN CAST(try_cast(strftime(d, '%Y-%m-') || least(CASE WHEN month(d) = 2 THEN 29 WHEN month(d) IN (4, 6, 9, 11) THEN 30 ELSE 31 END, 31) AS DATE) AS VARCHAR)
                     ELSE strftime(d, '%Y-%m-15') END AS "end",
              CASE WHEN k = 4 THEN 'delivery_unparsed' ELSE '' END AS notes FROM d""",
)
def q30_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    label = (
        F.when(k == 0, F.concat(F.date_format(d, "M/d/yyyy"), F.lit(" - "), F.date_format(F.date_add(d, 20), "M/d/yy")))
        .when(k == 1, F.date_format(d, "MMMM yyyy")).when(k == 2, F.concat(F.date_format(d, "MMM d"), F.lit(" - 31, "), F.year(d).cast("string")))
        .when(k == 3, F.concat(F.date_format(d, "MMMM"), F.lit(" 1 - 15 "), F.year(d).cast("string"))).otherwise("whenever")
    )
    read = dates.delivery(label, F.to_date(F.lit("1998-06-15")), F.lit("CORN"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", read["start"].cast("string").alias("start"), read["end"].cast("string").alias("end"), F.array_join(read["notes"], ",").alias("notes")
    )


@query(
    "q30_delivery_inferred",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
       y AS (SELECT *, 1998 + CASE WHEN make_date(1998, month(d), 1) < DATE '1998-06-15' - 45 THEN 1 ELSE 0 END AS y FROM d)
       SELECT o_orderkey, CAST(make_date(y, month(d), 1) AS VARCHAR) AS "start", CASE WHEN month(d) = 2 THEN NULL ELSE CAST(last_day(make_date(y, month(d), 1)) AS VARCHAR) END AS "end",
              'year_inferred' AS notes FROM y""",
)
def q30_delivery_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.date_format("o_orderdate", "MMM"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(".")).otherwise(F.lit(" ")))
    read = dates.delivery(label, F.to_date(F.lit("1998-06-15")), F.lit(None).cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", read["start"].cast("string").alias("start"), read["end"].cast("string").alias("end"), F.array_join(read["notes"], ",").alias("notes")
    )


@query("q31_futures_month", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS futures_month FROM orders")
def q31_futures_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    symbol = F.concat(F.lit("ZC"), F.substring(F.lit("FGHJKMNQUVXZ"), F.month(d), F.lit(1)), F.date_format(d, "yy"))
    text = F.when(F.col("o_orderkey") % 3 == 0, symbol).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "MMM yy")).otherwise(F.concat(F.date_format(d, "MMMM"), F.lit(" '"), F.date_format(d, "yy"), F.lit(" Corn")))
    return table(spark, sf_dir, "orders").select("o_orderkey", notation.futures_month(text, F.to_date(F.lit("1998-06-15"))).alias("futures_month"))


@query(
    "q33_shape_role",
    """SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'cash_price' WHEN 'N' THEN 'basis' ELSE 'futures_price' END AS role,
       round(CASE l_returnflag WHEN 'R' THEN 1.0 ELSE avg(CASE WHEN l_orderkey % 7 = 0 THEN 0.0 ELSE 1.0 END) END, 6) AS conf FROM lineitem GROUP BY l_returnflag""",
)
def q33_shape_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    value = (
        F.when((F.col("l_orderkey") % 7 == 0) & (flag != "R"), "odd one").when(flag == "A", F.format_number(F.col("l_quantity") / 10, 4))
        .when(flag == "N", F.concat(F.lit("-"), F.format_number("l_discount", 2))).otherwise(F.concat((F.floor("l_quantity") + 400).cast("string"), F.lit("-2s")))
    )
    cells = table(spark, sf_dir, "lineitem").select(flag.alias("page_id"), F.lit(0).alias("grid"), F.lit(0).alias("col"), value.alias("cell"))
    role = shape_role({n: F.col(n) for n in SHAPES})
    return column_shapes(cells).select(F.col("page_id").alias("l_returnflag"), role["role"].alias("role"), F.round(role["conf"], 6).alias("conf"))
