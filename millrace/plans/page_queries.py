"""Pages: grids, links, vendors, probing, over the driver's pages and over pages rendered from its numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import links as L
from millrace.operators.extract import extract_bids
from millrace.plans.registry import query
from millrace.session import table


@query(
    "q12_href_scan",
    """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""",
)
def q12_href_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(
    "q13_pattern_hits",
    r"""SELECT doc_id, len(regexp_extract_all(text, '\b\d{1,2}\.\d{2,4}\b')) AS prices,
        len(regexp_extract_all(text, '[+-]\s?\d{0,2}\.\d{2,4}\b')) AS bases FROM documents""",
)
def q13_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.price_hits(F.col("text")).cast("long").alias("prices"), T.basis_hits(F.col("text")).cast("long").alias("bases"))


@query(
    "q14_registered_domain",
    r"""WITH h AS (SELECT page_id, regexp_replace(regexp_extract(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^([^:]*)', 1), '^www\.', '') AS h FROM pages)
        SELECT page_id, CASE WHEN len(string_split(h, '.')) >= 2 THEN array_to_string(string_split(h, '.')[-2:], '.') ELSE h END AS domain FROM h""",
)
def q14_registered_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.registered_domain(T.host(F.col("url")), strip_letters=False).alias("domain"))


@query(
    "q26_html_round_trip",
    """SELECT l_orderkey AS page_id, count(*) AS n_rows, CAST(sum(CAST(round(l_quantity / 10, 4) AS DECIMAL(18,4))) AS DOUBLE) AS cash, CAST(sum(CAST(-round(l_discount, 4) AS DECIMAL(18,4))) AS DOUBLE) AS basis,
       'CORN' AS commodity, count(*) FILTER (l_tax > 0) AS n_changed FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3""",
)
def q26_html_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renders an HTML table for every order of three lines or more, then discovers, scores, names and reads it again."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    cash, basis = F.col("l_quantity") / 10, F.col("l_discount")
    row = F.concat(
        F.lit("<tr>"), cell(F.date_format("l_shipdate", "MMMM yyyy")), cell(F.format_number(cash, 4)), cell(F.concat(F.lit("-"), F.format_number(basis, 4))),
        cell(F.format_number(cash + basis, 4)), cell(F.when(F.col("l_tax") > 0, F.concat(F.lit("+"), F.format_number("l_tax", 4))).otherwise("unch")), F.lit("</tr>"),
    )
    head = "<html><body><h2>Yellow Corn</h2><table><tr><th>Delivery</th><th>Cash Bid</th><th>Basis</th><th>Futures</th><th>Change</th></tr>"
    pages = (
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.count("*").alias("n"), F.array_join(F.collect_list(row), "").alias("rows"))
        .where("n >= 3").select("page_id", F.concat(F.lit(head), F.col("rows"), F.lit("</table></body></html>")).alias("html"))
    )
    bids, _ = extract_bids(pages, F.to_date(F.lit("1998-06-15")))
    total = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double")
    return bids.groupBy("page_id").agg(
        F.count("*").alias("n_rows"), total("cash_price").alias("cash"), total("basis").alias("basis"), F.max("commodity").alias("commodity"),
        F.count_if(F.col("change") > 0).alias("n_changed"),
    )


_ANCHORS = [("/cashbids-{k}", "Cash Bids", 12.0), ("/markets/grain", "Grain Markets", 2.0), ("/bids", "Bids", 2.0), ("/news/bids", "Bids", -1.0), ("/about", "About us", -3.0), ("/locations/elevator-prices", "Prices", 2.0)]


@query(
    "q27_link_scoring",
    "SELECT page_id, ([" + ", ".join(str(s) for *_, s in _ANCHORS) + f"])[CAST(page_id % {len(_ANCHORS)} AS INT) + 1] AS score FROM pages",
)
def q27_link_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("page_id") % len(_ANCHORS)).cast("int")
    pick = lambda n: F.get(F.array(*(F.lit(a[n]) for a in _ANCHORS)), k)
    base = F.lit("https://coop.example")
    links = table(spark, sf_dir, "pages").select("page_id", F.concat(base, F.replace(pick(0), F.lit("{k}"), F.col("page_id").cast("string"))).alias("url"), pick(1).alias("anchor_text"))
    known = table(spark, sf_dir, "pages").select("page_id", F.concat(base, F.lit("/cashbids-"), (F.col("page_id") + 1).cast("string")).alias("known_url"))
    return L.score_links(L.with_siblings(links, known, key=["page_id"])).select("page_id", "score")


@query(
    "q28_vendor",
    "SELECT page_id, (['unknown', 'cloudflare', 'barchart', 'dtn', 'bushel_ssr', 'barchart'])[CAST(page_id % 6 AS INT) + 1] AS vendor, page_id % 6 IN (1, 2, 3, 5) AS scripted FROM pages",
)
def q28_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = ["", "<title>Just a Moment</title>", "<div class='BC-DataTable'>", "hosted.dtn.com", "ul.sevenColumnsBigFirst", "agricharts.com dtn-cash"]
    html = F.concat("html", F.get(F.array(*map(F.lit, marks)), (F.col("page_id") % 6).cast("int")))
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return pages.select("page_id", T.vendor(F.col("html")).alias("vendor"), T.needs_render(F.col("html"), F.lit(9.0), F.lit(0)).alias("scripted"))


@query("q41_discover", "SELECT page_id, 'https://coop.example/cashbids' AS url, 7.0 AS score, 1 AS rank FROM pages WHERE page_id % 2 = 0")
def q41_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.when(F.col("page_id") % 2 == 0, '<a href="/cashbids/">Cash Bids today</a><a href="https://other.example/cashbids">x</a><a href="#cashbids">y</a>').otherwise("")
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("https://coop.example/home").alias("url"), F.concat(F.lit("<p>"), extra, F.lit("</p>")).alias("html"))
    known = pages.select("page_id", F.col("url").alias("known_url"))
    return L.discover(pages, known).select("page_id", "url", "score", "rank")


@query(
    "q42_search_target",
    "SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL ELSE 'https://coop.example/bids?id=' || page_id END AS target FROM pages",
)
def q42_search_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://coop.example/bids?id="), F.col("page_id").cast("string"))
    coded = F.rtrim(F.translate(F.base64(url.cast("binary")), "+/", "-_"), F.lit("="))
    k = F.col("page_id") % 4
    href = (
        F.when(k == 0, F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode(url), F.lit("&rut=1")))
        .when(k == 1, F.concat(F.lit("https://www.bing.com/ck/a?!&&p=1&u=a1"), coded, F.lit("&ntb=1"))).when(k == 2, url).otherwise("/relative")
    )
    return table(spark, sf_dir, "pages").select("page_id", T.search_target(href).alias("target"))
