"""Quality rules, report columns and small lookups, over the driver's tables in the roles of the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.fuzzy import header_role_udf
from millrace.operators import links, quality, report, scan, store
from millrace.plans.registry import query
from millrace.session import table


@query(
    "q43_latest_scan",
    """SELECT c.o_custkey AS site_id, c.o_orderkey AS newest, f.o_orderkey AS newest_full FROM
         (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) c
         LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderkey % 3 > 0) f
         ON f.o_custkey = c.o_custkey AND f.rn = 1 WHERE c.rn = 1""",
)
def q43_latest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site_id"), "o_orderkey", (F.col("o_orderkey") % 3).alias("rows"))
    order = [F.desc("o_orderkey")]
    last = store.newest(scans, ["site_id"], order).select("site_id", F.col("o_orderkey").alias("newest"))
    full = store.newest(scans.where("rows > 0"), ["site_id"], order).select("site_id", F.col("o_orderkey").alias("newest_full"))
    return last.join(full, "site_id", "left")


@query(
    "q44_site_memory",
    """SELECT o_custkey AS site_id, CAST(arg_max(o_orderdate, o_orderkey) AS VARCHAR) AS last_success_at, arg_max(o_orderkey % 4, o_orderkey) AS rows_extracted, count(*) AS successes
       FROM orders WHERE o_orderkey % 4 > 0 GROUP BY o_custkey""",
)
def q44_site_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("site_id"), F.col("o_orderkey").alias("page_scan_id"), F.col("o_orderdate").alias("fetched_at"), (F.col("o_orderkey") % 4).alias("rows_extracted")
    )
    found = scan.last_successes(scans)
    return found.select("site_id", F.col("last_success_at").cast("string").alias("last_success_at"), "rows_extracted", "successes")


@query(
    "q45_stale_flags",
    """SELECT o_custkey AS site_id, 'STALE_ASOF' AS code FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') >= 2000
       UNION ALL SELECT o_custkey, 'STALE_DELIVERY' FROM orders GROUP BY o_custkey HAVING max(CAST(o_orderdate AS DATE)) + 200 < DATE '2001-08-01'""",
)
def q45_stale_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site_id"), F.to_date("o_orderdate").alias("as_of_date"))
    bids = orders.select("site_id", F.date_add("as_of_date", 200).alias("delivery_end"))
    return quality.stale_dates(orders, bids, F.to_date(F.lit("2001-08-01")), stale=2000)


@query(
    "q46_repeated_scans",
    """WITH r AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events),
       h AS (SELECT user_id, event_type FROM r WHERE rn = 1)
       SELECT r.user_id AS site_id, 'STALE_REPEAT' AS code, count(*) + 1 AS n_scans FROM r JOIN h USING (user_id, event_type) WHERE rn <= 4
       GROUP BY r.user_id HAVING count(*) >= 3 AND min(ts) <= TIMESTAMP '2024-01-29 00:00:00'""",
)
def q46_repeated_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("site_id"), F.col("event_id").alias("scan_id"), F.col("event_type").alias("content_signature"), F.col("ts").alias("fetched_at")
    )
    return quality.repeated_scans(scans, F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), identical=4)


@query(
    "q47_first_overlap",
    """WITH i AS (SELECT DISTINCT o_orderpriority AS grp, o_custkey AS site, CAST(o_orderdate AS DATE) AS item FROM orders),
       z AS (SELECT grp, site, count(*) AS n FROM i GROUP BY ALL),
       p AS (SELECT a.grp, a.site, b.site AS other, count(*) / max(n) AS share FROM i a JOIN i b ON a.grp = b.grp AND a.item = b.item AND a.site <> b.site
             JOIN z ON z.grp = a.grp AND z.site = a.site GROUP BY ALL HAVING count(*) / max(n) >= 0.3)
       SELECT site, min(other) AS other FROM p GROUP BY site""",
)
def q47_first_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("site"), F.to_date("o_orderdate").alias("item")
    )
    return quality.first_others(rows, group="grp", member="site", item="item", least=0.3)


@query(
    "q48_report_columns",
    """SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END, ''), 'raw') AS commodity,
       coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2026-09' END, ''), 'Sep') AS fut_month, CASE WHEN p_partkey % 2 = 0 THEN 'converted from cents' END AS notes FROM part""",
)
def q48_report_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    missing = lambda kind: F.lit(None).cast(kind)
    rows = table(spark, sf_dir, "part").select(
        k.alias("place"), F.lit(False).alias("breaks"), F.lit(False).alias("shaded"), F.lit("one").alias("company_name"), F.lit("two").alias("site_label"),
        F.when(k % 5 == 0, "").when(k % 7 != 0, F.col("p_type")).alias("commodity"), F.lit("raw").alias("commodity_raw"), missing("string").alias("delivery_raw"),
        missing("date").alias("delivery_start"), missing("date").alias("delivery_end"), missing("double").alias("cash_price"), missing("double").alias("basis"),
        F.when(k % 3 == 0, "").otherwise("2026-09").alias("futures_month"), F.lit("Sep").alias("futures_month_raw"), missing("double").alias("futures_price"),
        missing("double").alias("change"), missing("date").alias("page_as_of"), F.when(k % 2 == 0, F.array(F.lit("unit_assumed_cents"))).alias("notes"),
    )
    return report.shown(rows, ["commodity", "fut_month", "notes"]).select(F.col("place").alias("p_partkey"), "commodity", "fut_month", "notes")


_HEADERS = {"Cash Bid": "cash_price", "Basis": "basis", "Delivery Period": "delivery_period", "Futures Month": "futures_price", "Chg": "change", "Comodity": "commodity", "Elevator": "location", "???": None, "Remarks": "notes", "Last Updated": "last_updated"}


@query(
    "q49_header_role",
    "SELECT p_partkey, ([" + ", ".join(f"'{v}'" if v else "NULL" for v in _HEADERS.values()) + f"])[CAST(p_partkey % {len(_HEADERS)} AS INT) + 1] AS role FROM part",
)
def q49_header_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, _HEADERS)), (F.col("p_partkey") % len(_HEADERS)).cast("int"))
    parts = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    known = parts.select("text").distinct().withColumn("role", header_role_udf("text"))
    return parts.join(known, "text").select("p_partkey", "role")


@query(
    "q50_normalized_url",
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://coop' || page_id || '.example/bids' WHEN 1 THEN 'http://coop.example' ELSE NULL END AS url FROM pages",
)
def q50_normalized_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" coop"), k.cast("string"), F.lit(".example/bids "))).when(k % 4 == 1, "http://coop.example").when(k % 4 == 2, "nodots").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", T.normalized_url(raw).alias("url"))


@query(
    "q51_probe",
    "SELECT page_id, page_id % 3 <> 2 AS looks_like_bid_page, CASE WHEN page_id % 3 = 0 THEN 'Corn,Soybeans' ELSE '' END AS commodities, CASE page_id % 3 WHEN 2 THEN 0 ELSE 3 END AS price_hits FROM pages",
)
def q51_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    html = F.when(k == 0, "<title>Bids</title><p>Corn and Beans</p><b>4.10</b> <b>4.20</b> <b>11.05</b>").when(k == 1, "<i>4.10 4.20 4.30</i>").otherwise("<p>welcome</p>")
    url = F.when(k == 1, "https://coop.example/CashBids").otherwise("https://coop.example/")
    found = links.probe(table(spark, sf_dir, "pages").select("page_id", url.alias("url"), html.alias("html")))
    return found.select("page_id", "looks_like_bid_page", F.array_join("commodities", ",").alias("commodities"), "price_hits")


@query(
    "q52_resolve_names",
    "SELECT s_name AS name, 'coop' || s_suppkey || '.example' AS domain, 4.0 + 2 + CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 0 END AS score FROM supplier",
)
def q52_resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("coop"), F.col("s_suppkey").cast("string")).alias("coop"), "s_suppkey")
    own = base.select(
        F.col("name"), "coop", F.lit(1).alias("nth"), F.concat(F.lit("https://www."), F.col("coop"), F.lit(".example/")).alias("url"), F.concat(F.col("coop"), F.lit(" home")).alias("title"),
        F.when(F.col("s_suppkey") % 2 == 0, "cash bids daily").otherwise("").alias("snippet"),
    )
    social = base.select("name", "coop", F.lit(2).alias("nth"), F.lit("https://www.facebook.com/x").alias("url"), F.col("coop").alias("title"), F.lit("cash bids").alias("snippet"))
    # looked for by the word that stands in the domain
    found = links.resolve_names(own.unionByName(social).withColumn("name", F.col("coop")).drop("coop"))
    return found.join(base.select("name", "coop").withColumnRenamed("name", "shown"), F.col("name") == F.col("coop")).select(F.col("shown").alias("name"), "domain", "score")
