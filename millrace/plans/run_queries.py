"""Runs that count as a whole, texts as of a time, and what a collection is put together from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import settings
from millrace.operators import aliases, links, registry, report, store
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources import fetch


@query(
    "q73_committed_runs",
    """WITH c AS (SELECT o_custkey AS run_id, arg_max(o_orderpriority, o_orderkey) AS attempt, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
       SELECT o.o_custkey AS run_id, c.status, count(*) AS n_rows, min(o.o_orderkey) AS first_row FROM orders o JOIN c ON c.run_id = o.o_custkey AND c.attempt = o.o_orderpriority GROUP BY ALL""",
)
def q73_committed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, priorities as attempts to write them: of each run the rows of the attempt that was committed last."""
    orders = table(spark, sf_dir, "orders")
    log = orders.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("run_id"), F.array("o_orderpriority").alias("attempts"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"))
    commits = store.newest_commits(log)
    rows = store.committed(orders.select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("attempt"), "o_orderkey"), commits)
    return rows.join(commits, "run_id").groupBy("run_id", "status").agg(F.count("*").alias("n_rows"), F.min("o_orderkey").alias("first_row"))


@query(
    "q74_robots_as_of",
    """WITH cache AS (SELECT user_id, ts, max(event_type) AS body FROM events WHERE event_type IN ('view', 'signup') GROUP BY ALL),
       asked AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
       SELECT a.event_id, c.ts IS NOT NULL AND a.ts - c.ts < INTERVAL 24 HOUR AS known, CASE WHEN a.ts - c.ts < INTERVAL 24 HOUR THEN c.body END AS body
       FROM asked a ASOF LEFT JOIN cache c ON a.user_id = c.user_id AND a.ts >= c.ts""",
)
def q74_robots_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as domains: views and signups as texts that were fetched, purchases as times at which one is asked for."""
    events = table(spark, sf_dir, "events")
    domain = F.col("user_id").cast("string").alias("domain")
    cache = events.where("event_type IN ('view', 'signup')").select(domain, F.col("event_type").alias("body"), F.col("ts").alias("fetched_at"))
    asked = events.where("event_type = 'purchase'").select("event_id", domain, F.col("ts").alias("at"))
    return asked.join(fetch.robots_as_of(asked, cache), ["domain", "at"]).select("event_id", "known", "body")


_OWN = {
    "1": {"sort_by": "cash_desc", "group_by": "location"}, "2": {"commodities": ["ECONOMY", "PROMO", "SMALL"], "locations": ["Brand#1", "Brand#2", "Brand#3", "Brand#4"], "horizon_months": 1},
    "3": {"group_by": "none", "sort_by": "commodity", "horizon_months": 0},
}


@query(
    "q75_company_overrides",
    """WITH p AS (SELECT p_partkey AS bid_id, p_size % 5 AS company, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS commodity, p_brand AS site,
           CASE WHEN p_partkey % 11 = 0 THEN 0.0 WHEN p_partkey % 13 <> 0 THEN p_retailprice END AS cash, CASE WHEN p_partkey % 3 <> 0 THEN DATE '2026-01-01' + 20 * p_size END AS ds FROM part),
       f AS (SELECT *, CASE company WHEN 1 THEN site WHEN 3 THEN NULL ELSE commodity END AS name FROM p
             WHERE CASE company WHEN 3 THEN true WHEN 2 THEN commodity IN ('ECONOMY', 'PROMO', 'SMALL') AND site IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') AND coalesce(ds <= DATE '2026-01-01' + 31, true)
                   ELSE coalesce(ds <= DATE '2026-01-01' + 31 * 12, true) END),
       o AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN company <> 3 THEN coalesce(nullif(name, ''), 'zzz') END, CASE WHEN company = 3 THEN coalesce(commodity, 'zzz') END,
               CASE WHEN company = 1 THEN CASE WHEN coalesce(cash, 0) = 0 THEN 999.0 ELSE -cash END END, CASE WHEN company NOT IN (1, 3) THEN coalesce(ds, DATE '2100-01-01') END,
               commodity NULLS FIRST, ds NULLS FIRST, bid_id) AS place FROM f)
       SELECT bid_id, company, place, place > 1 AND name IS DISTINCT FROM lag(name) OVER (PARTITION BY company ORDER BY place) AS breaks, place % 2 = 0 AS shaded FROM o""",
)
def q75_company_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as bids of five companies, three with settings of their own: the rows of all sheets by one plan."""
    k = F.col("p_partkey")
    bids = table(spark, sf_dir, "part").select(
        k.alias("bid_id"), (F.col("p_size") % 5).alias("company_id"), F.lit("one").alias("company_name"), F.when(k % 7 != 0, F.col("p_type")).alias("commodity"), F.col("p_brand").alias("site_label"),
        F.when(k % 11 == 0, 0.0).when(k % 13 != 0, F.col("p_retailprice")).alias("cash_price"), F.when(k % 3 != 0, F.date_add(F.to_date(F.lit("2026-01-01")), F.col("p_size") * 20)).alias("delivery_start"),
    )
    doc = settings.merged(settings.DEFAULTS, {"company_overrides": _OWN})
    own = spark.createDataFrame(settings.overrides(doc), settings.OVERRIDES)
    rows = report.company_rows(bids, own, settings.effective(doc), F.to_date(F.lit("2026-01-01")))
    return rows.select("bid_id", F.col("company_id").alias("company"), F.col("place").cast("long").alias("place"), "breaks", "shaded")


@query(
    "q76_cascade",
    """WITH o AS (SELECT o_orderkey, o_custkey AS company, o_custkey || '-' || o_orderpriority AS site, CAST(o_orderdate AS DATE) AS day FROM orders),
       c AS (SELECT company, max(day) AS gone FROM o WHERE o_orderkey % 11 = 0 GROUP BY company), s AS (SELECT site, max(day) AS gone FROM o WHERE o_orderkey % 7 = 0 GROUP BY site)
       SELECT o_orderkey, o.site, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS live_site FROM o LEFT JOIN c USING (company) LEFT JOIN s USING (site)
       WHERE coalesce(day > c.gone, true) AND coalesce(day > s.gone, true)""",
)
def q76_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies and their orders of a priority as sites: some orders delete the one, some the other, later ones
    make them anew. Orders are also what hangs on sites: those that both deletions leave."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("company_id"), F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderpriority").alias("site_id"), F.to_date("o_orderdate").alias("at")
    )
    k = F.col("o_orderkey")
    companies, sites = orders.select("company_id", "at", (k % 11 == 0).alias("deleted")), orders.select("site_id", "company_id", "o_orderkey", "at", (k % 7 == 0).alias("deleted"))
    left = registry.cascade(companies, sites, {"bids": orders})
    written = left["sites"].select("o_orderkey", F.lit(True).alias("site_is_left"))
    return left["bids"].join(written, "o_orderkey", "left").select("o_orderkey", F.col("site_id").alias("site"), (F.coalesce("site_is_left", F.lit(False)) & (k % 11 != 0)).alias("live_site"))


@query(
    "q77_blocklist",
    """WITH d AS (SELECT c_custkey, 'd' || c_custkey % 97 || '.site' || c_nationkey || '.example' AS domain FROM customer),
       b AS (SELECT 'site' || s_nationkey || '.example' AS listed FROM supplier WHERE s_suppkey % 3 = 0 UNION SELECT 'd' || s_suppkey || '.site' || s_nationkey || '.example' FROM supplier)
       SELECT c_custkey, bool_or(b.listed IS NOT NULL) AS listed FROM d LEFT JOIN b ON d.domain = b.listed OR ends_with(d.domain, '.' || b.listed) GROUP BY c_custkey""",
)
def q77_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' domains against a list of suppliers' domains, whole ones and ones that they are part of."""
    text = lambda c: F.col(c).cast("string")
    domains = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("d"), (F.col("c_custkey") % 97).cast("string"), F.lit(".site"), text("c_nationkey"), F.lit(".example")).alias("domain"))
    suppliers = table(spark, sf_dir, "supplier")
    own = F.concat(F.lit("site"), text("s_nationkey"), F.lit(".example"))
    listed = suppliers.where("s_suppkey % 3 = 0").select(own.alias("domain")).union(suppliers.select(F.concat(F.lit("d"), text("s_suppkey"), F.lit("."), own)))
    return links.on_list(domains, listed).select("c_custkey", "listed")


@query(
    "q78_alias_table",
    """WITH a AS (SELECT DISTINCT p_name AS alias, 'long ' || p_name AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2), 'short ' || split_part(p_name, ' ', 2) FROM part),
       t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'A ' || p_name || ', ' || p_type WHEN 1 THEN upper(split_part(p_name, ' ', 2)) || '!' WHEN 2 THEN split_part(p_name, ' ', 1) ELSE 'x' || p_name END AS text FROM part)
       SELECT p_partkey, arg_max(name, length(alias)) AS commodity FROM t LEFT JOIN a ON regexp_matches(lower(text), '\\b' || alias || '\\b') GROUP BY p_partkey""",
)
def q78_alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as aliases, one in another: the longest in a text counts."""
    part = table(spark, sf_dir, "part")
    noun = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    known = part.select(F.col("p_name").alias("alias"), F.concat(F.lit("long "), "p_name").alias("name")).union(part.select(noun, F.concat(F.lit("short "), noun))).distinct()
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("A "), "p_name", F.lit(", "), "p_type")).when(k == 1, F.concat(F.upper(noun), F.lit("!"))).when(k == 2, F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))).otherwise(F.concat(F.lit("x"), "p_name"))
    return aliases.named(part.select("p_partkey", text.alias("text")), "text", known).select("p_partkey", "commodity")
