"""Views, joins, aggregates, windows and orders, over the driver's tables in the roles of the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.functions.text import notes_text
from millrace.operators import quality, report, store
from millrace.plans.registry import query
from millrace.session import table


@query(
    "q01_latest_only",
    """SELECT event_id, user_id, event_type, round(value, 4) AS value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events
       ) WHERE rn = 1 AND value > 5""",
)
def q01_latest_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.newest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return rows.where("value > 5").select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))


@query("q02_value_hash", "SELECT event_id, substr(sha256(printf('%.4f', value)), 1, 32) AS value_hash FROM events")
def q02_value_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", hashing.value_hash(F.col("value")).alias("value_hash"))


@query(
    "q03_content_signature",
    """SELECT user_id, substr(sha256(array_to_string(list_sort(list(CAST(event_id AS VARCHAR) || ':' || printf('%.4f', value))), '|')), 1, 32) AS signature
       FROM events GROUP BY user_id""",
)
def q03_content_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(hashing.content_signature(F.col("event_id").cast("string"), hashing.four_places(F.col("value"))).alias("signature"))


@query(
    "q04_best_bid",
    """SELECT commodity, win AS "window", p_partkey, cash_price FROM (
         SELECT p_type AS commodity, CASE WHEN p_size <= 20 THEN 'Nearby' ELSE 'Deferred' END AS win, p_partkey, round(p_retailprice, 4) AS cash_price,
                row_number() OVER (PARTITION BY p_type, p_size <= 20 ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1""",
)
def q04_best_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.to_date(F.lit("2026-07-02"))
    bids = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("commodity"), F.col("p_retailprice").alias("cash_price"), F.date_add(today, F.col("p_size") * 3).alias("delivery_start"), "p_partkey"
    )
    best = quality.best_bids(bids, today, order=[F.asc("p_partkey")])
    return best.select("commodity", "window", "p_partkey", F.round("cash_price", 4).alias("cash_price"))


@query(
    "q05_overlap",
    """WITH i AS (SELECT DISTINCT n_regionkey AS region, s_suppkey AS site, l_partkey AS item FROM lineitem
                  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
       z AS (SELECT region, site, count(*) AS size FROM i GROUP BY ALL)
       SELECT a.region, a.site, b.site AS other, round(count(*) / max(size), 6) AS share
       FROM i a JOIN i b ON a.region = b.region AND a.item = b.item AND a.site <> b.site JOIN z ON z.region = a.region AND z.site = a.site
       GROUP BY ALL HAVING count(*) / max(size) >= 0.02""",
)
def q05_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_regionkey").alias("region"), F.col("s_suppkey").alias("site"), F.col("l_partkey").alias("item"))
    )
    return quality.overlaps(rows, group="region", member="site", item="item", least=0.02).withColumn("share", F.round("share", 6))


_STREAK = """SELECT user_id, coalesce(min(CASE WHEN event_type <> head THEN rn END), count(*) + 1) - 1 AS streak FROM (
         SELECT user_id, event_type, rn, first_value(event_type) OVER (PARTITION BY user_id ORDER BY rn) AS head FROM (
           SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5)
       GROUP BY user_id"""


@query("q06_repeat_streak", _STREAK)
def q06_repeat_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeat_streak(table(spark, sf_dir, "events"), key="user_id", signature="event_type", newest=[F.desc("ts"), F.desc("event_id")])


@query(
    "q08_upper_median",
    "SELECT l_suppkey, round(list_sort(list(abs(l_discount - 0.05)))[CAST(floor(count(*) / 2) AS INT) + 1], 6) AS median FROM lineitem GROUP BY l_suppkey",
)
def q08_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.upper_median(table(spark, sf_dir, "lineitem"), "l_suppkey", F.abs(F.col("l_discount") - 0.05))
    return found.select("l_suppkey", F.round("median", 6).alias("median"))


@query(
    "q11_agreement_ratio",
    """SELECT l_suppkey, round(avg(CASE WHEN abs(l_extendedprice / 1000 - l_quantity - l_discount) <= 20 THEN 1.0 ELSE 0.0 END), 6) AS ratio
       FROM lineitem GROUP BY l_suppkey""",
)
def q11_agreement_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = F.abs(F.col("l_extendedprice") / 1000 - F.col("l_quantity") - F.col("l_discount")) <= 20
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(fits.cast("double")), 6).alias("ratio"))


@query("q15_json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q15_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    "q16_left_anti",
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
)
def q16_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query(
    "q17_freshness",
    """SELECT o_orderkey, CASE WHEN d >= 1500 THEN 'STALE' WHEN d > 700 THEN 'AGING' ELSE 'FRESH' END AS status
       FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS d FROM orders)""",
)
def q17_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = quality.freshness(F.to_date("o_orderdate"), F.to_date(F.lit("2001-08-01")), aging=700, stale=1500)
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@query(
    "q18_horizon",
    """SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders)
       WHERE d IS NULL OR d <= DATE '1996-01-01' + 31 * 36""",
)
def q18_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").where(report.in_horizon(start, F.to_date(F.lit("1996-01-01")), 36)).select("o_orderkey")


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as bids: some without a grain, a price or a start."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("bid_id"), F.when(k % 7 != 0, F.col("p_type")).alias("commodity"), F.col("p_brand").alias("site_label"), F.lit("one").alias("company_name"),
        F.when(k % 11 == 0, 0.0).when(k % 13 != 0, F.col("p_retailprice")).alias("cash_price"),
        F.when(k % 3 != 0, F.date_add(F.to_date(F.lit("2026-01-01")), F.col("p_size"))).alias("delivery_start"),
    )


_SHEET = """p AS (SELECT p_partkey AS bid_id, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS commodity, p_brand AS site_label,
         CASE WHEN p_partkey % 11 = 0 THEN 0.0 WHEN p_partkey % 13 <> 0 THEN p_retailprice END AS cash_price,
         CASE WHEN p_partkey % 3 <> 0 THEN DATE '2026-01-01' + p_size END AS ds FROM part)"""


@query(
    "q19_group_sort",
    f"""WITH {_SHEET} SELECT bid_id, row_number() OVER (ORDER BY coalesce(commodity, 'zzz'), CASE WHEN coalesce(cash_price, 0) = 0 THEN 999.0 ELSE -cash_price END,
        commodity NULLS FIRST, ds NULLS FIRST, bid_id) AS place FROM p""",
)
def q19_group_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.report_rows(_sheet(spark, sf_dir), {"group_by": "commodity", "sort_by": "cash_desc"}, F.to_date(F.lit("2026-01-01")))
    return rows.select("bid_id", F.col("place").cast("long").alias("place"))


@query(
    "q35_group_break",
    f"""WITH {_SHEET}, o AS (SELECT *, row_number() OVER (ORDER BY coalesce(site_label, 'zzz'), coalesce(ds, DATE '2100-01-01'), commodity NULLS FIRST, ds NULLS FIRST, bid_id) AS place FROM p)
        SELECT bid_id, place, place > 1 AND site_label IS DISTINCT FROM lag(site_label) OVER (ORDER BY place) AS breaks, place % 2 = 0 AS shaded FROM o""",
)
def q35_group_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.report_rows(_sheet(spark, sf_dir), {"group_by": "location", "sort_by": "delivery_start"}, F.to_date(F.lit("2026-01-01")))
    return rows.select("bid_id", F.col("place").cast("long").alias("place"), "breaks", "shaded")


@query(
    "q20_dup_ordinal",
    """SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity) - 1 AS nth FROM lineitem""",
)
def q20_dup_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) - 1).cast("long").alias("nth"))


@query(
    "q21_star_join",
    """SELECT n_name, count(*) AS n_bids, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def q21_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    # sums by order before the wider joins: one row per order goes on
    by_order = lines.groupBy("l_orderkey").agg(F.sum("price").alias("total"), F.count("*").alias("n"))
    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = by_order.join(orders, "l_orderkey").join(named, "c_custkey")
    return rows.groupBy("n_name").agg(F.sum("n").alias("n_bids"), F.sum("total").cast("double").alias("total"))


@query(
    "q22_option_union",
    "SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(list(event_type), ['call', 'click']))), ',') AS options FROM events GROUP BY user_id",
)
def q22_option_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.array(F.lit("call"), F.lit("click"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("event_type"), chosen)), ",").alias("options"))


@query(
    "q23_run_totals",
    """SELECT o_orderpriority AS run_id, count(*) AS pages, CAST(sum(o_custkey % 10) AS BIGINT) AS "rows", CAST(sum(o_orderkey % 3) AS BIGINT) AS flags,
       CASE WHEN bool_or(o_orderstatus = 'P' AND o_orderkey % 1000 = 7) THEN 'partial' ELSE 'complete' END AS status FROM orders GROUP BY o_orderpriority""",
)
def q23_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("run_id"), (F.col("o_custkey") % 10).alias("rows_extracted"), (F.col("o_orderkey") % 3).alias("n_flags"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 1000 == 7), "fetch_failed").otherwise("low_confidence").alias("outcome"),
    )
    return quality.run_status(pages)


@query(
    "q24_history",
    "SELECT user_id, event_id, rn AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 30",
)
def q24_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("nth", F.row_number().over(w).cast("long"))
    return rows.where("nth <= 30").select("user_id", "event_id", "nth")


@query(
    "q32_notes_text",
    """SELECT p_partkey, nullif(array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'delivery year assumed from page date' END,
         CASE WHEN p_partkey % 3 = 0 THEN 'converted from cents' END, CASE WHEN p_partkey % 5 = 0 THEN 'basis value looked off' END], lambda x: x IS NOT NULL), '; '), '') AS notes FROM part""",
)
def q32_notes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    names = F.array(
        F.when(k % 2 == 0, "year_inferred"), F.lit("something_else"), F.when(k % 3 == 0, "unit_assumed_cents"), F.when(k % 5 == 0, "basis_out_of_range")
    )
    return table(spark, sf_dir, "part").select("p_partkey", notes_text(F.filter(names, lambda n: n.isNotNull())).alias("notes"))


@query(
    "q34_identity_hash",
    """SELECT o_orderkey, substr(sha256(concat(CAST(o_custkey AS VARCHAR), '|', CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority ELSE '' END, '|',
         CASE WHEN o_orderkey % 3 = 0 THEN 'raw corn' ELSE o_orderstatus END, '|',
         CASE WHEN o_orderkey % 5 = 0 THEN 'whenever' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '|None' END, '|')), 1, 32) AS row_hash FROM orders""",
)
def q34_identity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    key = hashing.delivery_key(F.when(k % 5 != 0, F.to_date("o_orderdate")), F.lit(None).cast("date"), F.lit("  Whenever "), none)
    row_hash = hashing.identity_hash(
        F.col("o_custkey"), F.when(k % 4 != 0, F.col("o_orderpriority")), F.when(k % 3 != 0, F.col("o_orderstatus")), F.lit("raw corn"), key, none
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", row_hash.alias("row_hash"))


@query(
    "q36_upsert_view",
    """SELECT user_id, event_type, CAST(min(ts) AS VARCHAR) AS first_seen_at, CAST(max(ts) AS VARCHAR) AS last_seen_at, arg_max(event_id, (ts, event_id)) AS event_id
       FROM events GROUP BY user_id, event_type""",
)
def q36_upsert_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    view = store.upsert_view(log, ["user_id", "event_type"], "ts", "event_id")
    return view.select("user_id", "event_type", F.col("first_seen_at").cast("string").alias("first_seen_at"), F.col("last_seen_at").cast("string").alias("last_seen_at"), "event_id")


@query(
    "q39_query_bids",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem)
       SELECT l_partkey AS row_hash, l_orderkey AS page_scan_id, c_name AS company_name, s_name AS site_label FROM b
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
       WHERE rn = 1 AND o_orderpriority = '1-URGENT'""",
)
def q39_query_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    order_of = orders.select(F.col("o_orderkey").alias("page_scan_id"), F.col("o_custkey").alias("company_id"))
    bids = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("row_hash"), F.col("l_orderkey").alias("page_scan_id"), F.struct("l_linenumber", "l_suppkey", "l_extendedprice").alias("bid_id"),
        F.col("l_suppkey").alias("site_id"),
    ).join(order_of, "page_scan_id")
    scans = orders.select(F.col("o_orderkey").alias("page_scan_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("run_id"), F.to_date("o_orderdate").alias("as_of_date"))
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"))
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("label"), F.lit("").alias("url"))
    return store.query_bids(bids, scans, companies, sites, run_id=1).select("row_hash", "page_scan_id", "company_name", "site_label")


@query(
    "q40_page_health",
    """WITH p AS (SELECT o_custkey AS site_id, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey),
       f AS (SELECT o_custkey AS site_id, min(o_orderkey) AS nth FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey)
       SELECT c_name AS location, CASE WHEN p.site_id IS NULL THEN 'FAILED' WHEN c_custkey % 11 = 0 THEN 'AGING' WHEN c_custkey % 9 >= 5 THEN 'STALE' WHEN c_custkey % 9 > 2 THEN 'AGING' ELSE 'FRESH' END AS status,
              coalesce(n, 0) AS n_rows, CASE WHEN p.site_id IS NULL THEN 'message ' || nth END AS failure,
              CASE WHEN p.site_id IS NULL THEN '' WHEN c_custkey % 4 >= 2 THEN 'Yes ×' || c_custkey % 4 ELSE 'No' END AS same_as_last
       FROM customer LEFT JOIN p ON p.site_id = c_custkey LEFT JOIN f ON f.site_id = c_custkey WHERE p.site_id IS NOT NULL OR f.site_id IS NOT NULL""",
)
def q40_page_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages whose bids are none to eight days old, or of unknown age; customers with flags alone have failed."""
    orders, today = table(spark, sf_dir, "orders"), F.to_date(F.lit("2001-08-01"))
    k = F.col("site_id")
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), F.lit("one").alias("company"), F.col("c_name").alias("location"), F.lit("").alias("url"))
    live = orders.where("o_orderkey % 3 <> 0").groupBy(F.col("o_custkey").alias("site_id")).agg(F.count("*").alias("rows"))
    live = live.withColumn("as_of", F.when(k % 11 != 0, F.date_sub(today, (k % 9).cast("int"))))
    flags = orders.where("o_orderkey % 3 = 0").select(
        F.col("o_custkey").alias("site_id"), F.col("o_orderkey").alias("nth"), F.lit("TIMEOUT").alias("code"),
        F.concat(F.lit("message "), F.col("o_orderkey").cast("string")).alias("message"), F.lit("").alias("suggestion"),
    )
    health = quality.page_health(live.join(sites, "site_id"), live.select("site_id", (k % 4).alias("streak")), flags.join(sites.select("site_id"), "site_id"), sites, today)
    failed = F.when(F.col("status") == "FAILED", F.col("notices"))
    return health.select("location", "status", F.col("rows").alias("n_rows"), failed.alias("failure"), "same_as_last")
