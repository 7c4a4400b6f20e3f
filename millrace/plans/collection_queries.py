"""Companies, sites, runs and builds; pages from their fetch to their outcome; over the driver's tables in these roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.operators import extract, flags, links, quality, registry, report
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources import fetch


def _pick(k: Column, values: list) -> Column:
    return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))


def _of(values: list[str], k: str) -> str:
    return "([" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"])[CAST({k} % {len(values)} AS INT) + 1]"


@query(
    "q53_kept_grid",
    """SELECT l_orderkey AS page_id, count(*) AS n_rows, CAST(sum(CAST(round(l_quantity / 10, 4) AS DECIMAL(18,4))) AS DOUBLE) AS cash, 'SORGHUM' AS commodity
       FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3""",
)
def q53_kept_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of alike elements without a table: each line of an order is one of them."""
    span = lambda c: F.concat(F.lit("<span>"), c, F.lit("</span>"))
    line = F.concat(F.lit("<div class='r'>"), span(F.date_format("l_shipdate", "MMMM yyyy")), span(F.format_number(F.col("l_quantity") / 10, 4)), span(F.lit("-0.4500")), F.lit("</div>"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_join(F.collect_list(line), "").alias("rows"), F.count("*").alias("n"))
    pages = rows.where("n >= 3").select("page_id", F.concat(F.lit("<section><h4>Milo prices</h4><div>"), "rows", F.lit("</div></section>")).alias("html"))
    bids, _ = extract.extract_bids(pages, F.to_date(F.lit("1998-06-15")))
    return bids.groupBy("page_id").agg(F.count("*").alias("n_rows"), F.sum(F.col("cash_price").cast("decimal(18,4)")).cast("double").alias("cash"), F.max("commodity").alias("commodity"))


_TABLE = "<h2>Corn</h2><table><tr><th>Delivery</th><th>{}</th><th>Basis</th></tr>" + "".join(f"<tr><td>{m} 2026</td><td>{c}</td><td>-0.15</td></tr>" for m, c in (("March", "4.1000"), ("May", "4.2000"), ("July", "4.3000"))) + "</table>"
_OUTCOMES = [_TABLE.format("Cash Bid"), "<p>Welcome</p>", "<h2>Corn</h2><table><tr><th>Delivery</th><th>Futures Month</th></tr>" + "<tr><td>March 1 - 15</td><td>May 26</td></tr>" * 3 + "</table>", "<![if x]>" + _TABLE.format("Cash Bid"), "<ul><li>a<li>b</ul>"]


@query(
    "q54_page_results",
    f"SELECT page_id, {_of(['', 'NO_BID_DATA', 'PARTIAL_COLUMNS', '', 'NO_BID_DATA'], 'page_id')} AS flags, CASE WHEN page_id % 5 IN (0, 3) THEN 3 ELSE 0 END AS n_rows, "
    "CASE WHEN page_id % 5 IN (0, 3) THEN 1.0 ELSE 0.0 END AS confidence, false AS crashed FROM pages",
)
def q54_page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of pages: bids, none, a table without prices, marked sections that no parser knows."""
    pages = table(spark, sf_dir, "pages").select("page_id", _pick(F.col("page_id"), _OUTCOMES).alias("html"))
    _, results = extract.extract_bids(pages, F.to_date(F.lit("2026-03-01")))
    return results.select("page_id", F.array_join("flags", ",").alias("flags"), F.col("n_rows").cast("int").alias("n_rows"), "confidence", "crashed")


_ROLE_ROWS = [
    {"cash_price": "4.10", "basis": "-0.13", "futures_price": "4.23", "delivery_period": "March 2026"}, {"cash_price": "410", "delivery_period": "March 2026"},
    {"futures_price": "423-4", "delivery_period": "March 2026"}, {"cash_price": "4.10", "basis": "-0.13", "futures_price": "4.55", "delivery_period": "March"},
    {"change": "+0-2", "delivery_period": "harvest"}, {"delivery_period": "Cash"},
]


@query(
    "q55_row_confidence",
    f"SELECT p_partkey, CAST({_of(['1.0', '0.9', '0.4', '0.9', '0.3', None], 'p_partkey')} AS DOUBLE) AS confidence, "
    f"{_of(['', 'unit_assumed_cents', '', 'year_inferred', 'newcrop_window_assumed', None], 'p_partkey')} AS notes FROM part WHERE p_partkey % 6 <> 5",
)
def q55_row_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure a row is: what was assumed, what is missing, and whether cash is futures plus basis. Rows without numbers go."""
    k = F.col("p_partkey")
    roles = {r: _pick(k, [x.get(r) for x in _ROLE_ROWS]) for r in ("commodity", "delivery_period", "cash_price", "basis", "futures_price", "futures_month", "change", "last_updated")}
    rows = table(spark, sf_dir, "part").select("p_partkey", *(c.cast("string").alias(r) for r, c in roles.items()), F.lit("corn").alias("commodity_ctx"), F.to_date(F.lit("2026-01-15")).alias("ref_date"))
    return extract.typed_rows(rows).select("p_partkey", "confidence", F.array_join("notes", ",").alias("notes"))


@query(
    "q56_last_update",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders",
)
def q56_last_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "MM/dd/yyyy")).when(k == 1, F.concat(F.date_format(day, "M/d/yy"), F.lit(" 10:15"))).when(k == 2, F.concat(F.lit("Last: "), F.date_format(day, "MMMM d, yyyy"))).otherwise("n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.last_update(text).alias("day"))


@query("q57_as_of", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def q57_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of a page that says of which day its prices are, and that day."""
    k, day = F.col("o_orderkey") % 3, F.to_date("o_orderdate")
    said = F.when(k == 0, F.concat(F.lit("Cash bids as of "), F.date_format(day, "EEEE, MMMM dd, yyyy"))).when(k == 1, F.concat(F.lit("Prices for "), F.date_format(day, "MMM d, yyyy"))).otherwise("No date here")
    pages = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("<body><p>Hello</p><b>"), said, F.lit("</b></body>")).alias("html"))
    from millrace.sources.html_grids import html_texts

    texts = html_texts(pages, id_col="o_orderkey")
    return texts.select(F.col("page_id").alias("o_orderkey"), dates.as_of(F.col("as_of_text")).alias("day"))


_HEADERS = ["Cash Price", "Delivery Date", "Basis", "Futures-Month!", "Last  Change", "Elevator", "PRICE", "Contract #2"]


@query("q58_vague_header", "SELECT p_partkey, p_partkey % 8 IN (0, 1, 4, 6, 7) AS vague FROM part")
def q58_vague_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", extract.vague(_pick(F.col("p_partkey"), _HEADERS)).alias("vague"))


@query(
    "q59_attention",
    f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'STALE' WHEN 1 THEN 'FAILED' ELSE 'CHECK' END AS kind FROM part WHERE p_partkey % 4 IN (0, 1) OR (p_partkey % 4 = 2 AND p_partkey % 3 = 0)",
)
def q59_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    health = table(spark, sf_dir, "part").select("p_partkey", _pick(k, ["STALE", "FAILED", "AGING", "FRESH"]).alias("status"), F.when(k % 3 == 0, "look").otherwise("").alias("suggestion"))
    return quality.attention(health).select("p_partkey", "kind")


@query(
    "q60_history_join",
    """SELECT l_partkey, l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS page_as_of FROM (
         SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE rn <= 5""",
)
def q60_history_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bids = table(spark, sf_dir, "lineitem").withColumn("page_scan_id", F.col("l_orderkey"))
    scans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_scan_id"), F.col("o_orderdate").alias("fetched_at"), F.to_date("o_orderdate").alias("as_of_date"))
    order = [F.desc(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return registry.history(bids, scans, key=["l_partkey"], order=order, n=5).select("l_partkey", "l_orderkey", "l_linenumber", "page_as_of")


_RUNS = "r AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'partial' ELSE 'running' END AS status FROM orders)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "partial").otherwise("running")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), status.alias("status"))


@query(
    "q61_builds",
    f"""WITH {_RUNS}, n AS (SELECT * FROM r ORDER BY run_id DESC LIMIT 100),
        b AS (SELECT p_partkey AS build_id, (SELECT max(run_id) FROM r) - (p_partkey % 40) * 8 AS run_id FROM part ORDER BY p_partkey DESC LIMIT 50)
        SELECT build_id, b.run_id, status AS run_status FROM b LEFT JOIN n ON n.run_id = b.run_id""",
)
def q61_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    last = runs.agg(F.max("run_id").alias("last"))
    builds = table(spark, sf_dir, "part").crossJoin(F.broadcast(last)).select(F.col("p_partkey").alias("build_id"), (F.col("last") - F.col("p_partkey") % 40 * 8).alias("run_id"))  # one row
    return registry.build_list(builds, runs).select("build_id", "run_id", "run_status")


@query("q62_latest_finished_run", f"WITH {_RUNS} SELECT max(run_id) AS run_id FROM r WHERE status IN ('complete', 'partial')")
def q62_latest_finished_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest_finished_run(_runs(spark, sf_dir))


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 7 == 0).alias("archived"), "c_nationkey")


@query(
    "q63_company_list",
    """WITH f AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 GROUP BY o_custkey),
       s AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY o_custkey)
       SELECT c_custkey AS company_id, c_name AS name, (c_custkey % 4)::BIGINT AS sites, CAST(newest AS DATE) AS last_scan, coalesce(n, 0) AS open_flags
       FROM customer LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN f ON f.o_custkey = c_custkey WHERE c_custkey % 7 <> 0""",
)
def q63_company_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order is a flag of its customer, every fifth of them resolved; customers have no site to three."""
    orders, companies = table(spark, sf_dir, "orders"), _companies(spark, sf_dir)
    sites = companies.select("company_id", F.explode(F.sequence(F.lit(0), (F.col("company_id") % 4).cast("int"))).alias("nth")).where("nth > 0")
    told = orders.where("o_orderkey % 3 = 0").select(
        F.lit(1).alias("run_id"), F.col("o_custkey").alias("site_id"), F.col("o_orderkey").alias("nth"), F.col("o_custkey").alias("company_id"), (F.col("o_orderkey") % 10 == 0).alias("resolved")
    )
    marks = orders.where("o_orderkey % 10 = 5").select(F.lit(1).alias("run_id"), F.col("o_custkey").alias("site_id"), F.col("o_orderkey").alias("nth"))
    scans = orders.select(F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("fetched_at"))
    found = registry.company_list(companies, sites, scans, registry.open_flags(told, marks))
    return found.select("company_id", "name", "sites", F.to_date("last_scan_at").alias("last_scan"), "open_flags")


@query(
    "q64_no_case_order",
    """WITH c AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN lower(c_name) ELSE c_name END || CASE WHEN c_custkey % 5 = 0 THEN 'É' ELSE 'e' END AS name FROM customer)
       SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), c_custkey) AS place FROM c""",
)
def q64_no_case_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k, name = F.col("c_custkey"), F.col("c_name")
    shown = F.concat(F.when(k % 3 == 0, F.upper(name)).when(k % 3 == 1, F.lower(name)).otherwise(name), F.when(k % 5 == 0, "É").otherwise("e"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", shown.alias("name"))
    w = Window.partitionBy("c_nationkey").orderBy(registry.no_case(F.col("name")), "c_custkey")
    return rows.select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("q65_enabled_sites", "SELECT s_suppkey FROM supplier JOIN customer ON c_custkey = s_suppkey WHERE s_suppkey % 4 <> 0 AND c_custkey % 7 <> 0")
def q65_enabled_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archiving a company turns its sites off."""
    sites = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("company_id"), (F.col("s_suppkey") % 4 != 0).alias("enabled"))
    return registry.enabled_sites(sites, _companies(spark, sf_dir)).select("s_suppkey")


@query(
    "q66_site_memory",
    """WITH s AS (SELECT o_custkey AS site, o_orderkey, CAST(o_orderdate AS DATE) AS day, 1 + o_orderkey % 2 AS tier, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS vendor,
         o_orderkey % 3 > 0 AND (o_custkey % 5 <> 0 OR CAST(o_orderdate AS DATE) >= DATE '1996-01-01') AS good, o_custkey % 5 <> 0 OR CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AS own FROM orders)
       SELECT site, coalesce(arg_max(tier, o_orderkey) FILTER (good), 1) AS preferred_tier, count(*) FILTER (good) AS tier_success_count,
         coalesce(arg_max(vendor, o_orderkey) FILTER (own AND vendor IS NOT NULL), 'unknown') AS vendor, max(day) FILTER (good) AS last_success FROM s GROUP BY site""",
)
def q66_site_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sites, orders as scans; every fifth site got a new address in 1996."""
    k = F.col("o_orderkey")
    scans = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("site_id"), k.alias("page_scan_id"), F.to_date("o_orderdate").alias("fetched_at"), (1 + k % 2).alias("tier"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("vendor"),
        F.lit(None).cast("string").alias("roles"), (k % 3).alias("rows_extracted"),
    )
    moved = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("site_id"), F.to_date(F.lit("1996-01-01")).alias("at"))
    memory = registry.site_memory(scans, moved)
    return memory.select(F.col("site_id").alias("site"), F.col("preferred_tier").cast("long").alias("preferred_tier"), "tier_success_count", "vendor", F.col("last_success_at").alias("last_success"))


@query(
    "q67_link_states",
    """WITH s AS (SELECT user_id AS site, event_type AS url, arg_max(round(value, 4), (ts, value)) AS score, count(*) AS n FROM events GROUP BY ALL),
       m AS (SELECT user_id AS site, event_type AS url FROM events WHERE event_id % 11 = 0 GROUP BY ALL)
       SELECT s.site, s.url, score, row_number() OVER (PARTITION BY s.site ORDER BY score DESC, s.url) AS rank FROM s ANTI JOIN m ON m.site = s.site AND m.url = s.url WHERE score >= 3""",
)
def q67_link_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found links as events of a user: the last score counts, marked ones are no candidates any more."""
    events = table(spark, sf_dir, "events")
    seen = events.select(F.col("user_id").alias("site_id"), F.col("event_type").alias("url"), F.lit("x").alias("anchor_text"), F.round("value", 4).alias("score"), F.col("ts").alias("at"))
    marks = events.where("event_id % 11 = 0").select(F.col("user_id").alias("site_id"), F.col("event_type").alias("url"), F.lit("dismissed").alias("status"), F.col("ts").alias("at"))
    found = registry.candidate_links(registry.link_states(seen, marks))
    return found.select(F.col("site_id").alias("site"), "url", "score", F.col("rank").cast("long").alias("rank"))


_STATUS = [200, 204, 301, 401, 404, 410, 429, 500, 503, 406]
_CODES = [None, None, "NETWORK_FAIL", "HTTP_403_BOTBLOCK", "HTTP_404", "HTTP_404", "HTTP_429", "HTTP_5XX", "HTTP_5XX", "HTTP_403_BOTBLOCK"]


@query("q68_status_flag", f"SELECT p_partkey, {_of(_CODES, 'p_partkey')} AS code FROM part")
def q68_status_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fetch.status_flag(_pick(F.col("p_partkey"), _STATUS)).alias("code"))


_TOLD = ["NO_BID_DATA", "HTTP_404", "STALE_ASOF", "SCAN_INTERNAL_ERROR", "DNS_FAIL"]


#: What the texts of these codes shall be, said once more, so that a change of them is seen.
_TEXTS = [
    ("error", "No cash-bid table was found on {page}."),
    ("error", "{page} is gone."),
    ("warn", "{page} says that its bids are some days old."),
    ("error", "{page} could not be worked on."),
    ("error", "The domain of {page} does not exist."),
]


@query(
    "q69_flag_texts",
    f"SELECT p_partkey, {_of([x for x, _ in _TEXTS], 'p_partkey')} AS severity, replace({_of([x for _, x in _TEXTS], 'p_partkey')}, '{{page}}', p_name) AS message FROM part",
)
def q69_flag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", _pick(F.col("p_partkey"), _TOLD).alias("code"))
    return flags.described(rows, F.col("p_name")).select("p_partkey", "severity", "message")


@query(
    "q70_robots",
    "SELECT page_id, 'https://site' || page_id || '.example/' || CASE WHEN page_id % 2 = 0 THEN 'private/bids' ELSE 'bids' END AS url FROM pages WHERE page_id % 4 = 3 OR (page_id % 4 = 0) OR page_id % 4 = 1",
)
def q70_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that their domain's rules allow: of four domains one has no rules, one allows what is asked for, one forbids it,
    and one forbids it to others only."""
    k = F.col("page_id") % 4
    domain = F.concat(F.lit("site"), F.col("page_id").cast("string"), F.lit(".example"))
    pages = table(spark, sf_dir, "pages").select("page_id", domain.alias("domain"), F.concat(F.lit("https://"), domain, F.when(k % 2 == 0, "/private/bids").otherwise("/bids")).alias("url"))
    body = F.when(k == 0, "User-agent: elsewhere\nDisallow: /private").when(k == 1, "User-agent: *\nDisallow: /private").when(k == 2, "User-agent: *\nDisallow: /private/")
    robots = pages.select("domain", body.alias("body")).where("body IS NOT NULL")
    return fetch.allowed(pages.select("url"), robots, "reader").join(pages, "url").select("page_id", "url")


@query(
    "q71_report_filters",
    """SELECT p_partkey AS bid_id FROM part WHERE p_partkey % 7 <> 0 AND p_type IN (SELECT min(p_type) FROM part UNION SELECT max(p_type) FROM part) AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#23')""",
)
def q71_report_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the grains and locations that the settings name."""
    k = F.col("p_partkey")
    ends = table(spark, sf_dir, "part").agg(F.min("p_type"), F.max("p_type")).first()
    rows = table(spark, sf_dir, "part").select(
        k.alias("bid_id"), F.when(k % 7 != 0, F.col("p_type")).alias("commodity"), F.col("p_brand").alias("site_label"), F.lit("one").alias("company_name"),
        F.col("p_retailprice").alias("cash_price"), F.lit(None).cast("date").alias("delivery_start"),
    )
    wanted = {"commodities": list(ends), "locations": ["Brand#11", "Brand#12", "Brand#13", "Brand#23"]}
    return report.report_rows(rows, wanted, F.to_date(F.lit("2026-01-01"))).select("bid_id")


@query(
    "q72_verified_names",
    """SELECT 'coop' || s_suppkey AS name, 'coop' || s_suppkey || '.example' AS domain, 6.0 + CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 0 END AS score,
       CASE WHEN s_suppkey % 3 = 0 THEN 'https://coop' || s_suppkey || '.example/cashbids' END AS suggested_bid_page FROM supplier""",
)
def q72_verified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homepages that link to bids speak for a candidate."""
    coop = F.concat(F.lit("coop"), F.col("s_suppkey").cast("string"))
    base = table(spark, sf_dir, "supplier").select(coop.alias("name"), "s_suppkey")
    results = base.select("name", F.lit(1).alias("nth"), F.concat(F.lit("https://www."), "name", F.lit(".example/")).alias("url"), F.concat("name", F.lit(" home")).alias("title"), F.lit("").alias("snippet"))
    html = F.when(F.col("s_suppkey") % 3 == 0, "<a href='/cashbids'>Cash Bids</a>").otherwise("<a href='/about'>About</a>")
    homepages = base.select(F.concat("name", F.lit(".example")).alias("domain"), html.alias("html"))
    return links.verified_names(links.resolve_names(results), homepages).select("name", "domain", "score", "suggested_bid_page")
