"""Companies, sites, runs, builds and found links: views over logs of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.store import newest

FINISHED = ("complete", "partial")
#: Rows that lists show, and score from which a found link is a candidate.
BUILDS, RUNS, LEAST_LINK = 50, 100, 3.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def no_case(text: Column) -> Column:
    """What names are sorted by: capital and small ASCII letters are alike, others are not."""
    return F.translate(text, _UPPER, _LOWER)


def enabled_sites(sites: DataFrame, companies: DataFrame) -> DataFrame:
    """Sites that are on and whose company isn't archived: archiving a company turns its sites off."""
    live = companies.where("NOT coalesce(archived, false)").select("company_id")
    return sites.where("coalesce(enabled, true)").join(live, "company_id", "left_semi")


def open_flags(flags: DataFrame, resolved: DataFrame) -> DataFrame:
    """Flags that nobody has marked as resolved; resolved(run_id, site_id, nth) is a log of such marks."""
    return flags.where("NOT coalesce(resolved, false)").join(resolved, ["run_id", "site_id", "nth"], "left_anti")


def company_list(companies: DataFrame, sites: DataFrame, scans: DataFrame, flags: DataFrame) -> DataFrame:
    """Companies that aren't archived: company_id, name, sites (off ones too), last_scan_at, open_flags (of their sites)."""
    counted = sites.groupBy("company_id").agg(F.count("*").alias("sites"))
    last = scans.groupBy("company_id").agg(F.max("fetched_at").alias("last_scan_at"))
    told = flags.groupBy("company_id").agg(F.count("*").alias("open_flags"))
    live = companies.where("NOT coalesce(archived, false)").select("company_id", "name")
    rows = live.join(counted, "company_id", "left").join(last, "company_id", "left").join(told, "company_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("sites", "open_flags")})


def latest_finished_run(runs: DataFrame) -> DataFrame:
    """One row: the largest run_id that is complete or partial; null if there is none."""
    return runs.where(F.col("status").isin(*FINISHED)).agg(F.max("run_id").alias("run_id"))


def build_list(builds: DataFrame, runs: DataFrame, *, last: int = BUILDS) -> DataFrame:
    """The last builds with the status of their run, which is null for runs beyond the last ones that are listed."""
    recent = runs.orderBy(F.desc("run_id")).limit(RUNS).select("run_id", F.col("status").alias("run_status"))
    return builds.orderBy(F.desc("build_id")).limit(last).join(recent, "run_id", "left")


def link_states(seen: DataFrame, marked: DataFrame) -> DataFrame:
    """Found links by site and address: score, anchor text and last_seen_at of the last time, first_seen_at, and status: what
    it was last marked as, or candidate. seen(site_id, url, anchor_text, score, at); marked(site_id, url, status, at)."""
    key = ["site_id", "url"]
    found = seen.groupBy(*key).agg(
        F.max_by(F.struct("anchor_text", "score"), F.struct("at", "score", "anchor_text")).alias("x"), F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at")
    )
    status = marked.groupBy(*key).agg(F.max_by("status", "at").alias("status"))
    return found.join(status, key, "left").select(*key, "x.*", "first_seen_at", "last_seen_at", F.coalesce("status", F.lit("candidate")).alias("status"))


def candidate_links(states: DataFrame, least: float = LEAST_LINK) -> DataFrame:
    """Links to look at, with their rank within the site: the best first."""
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("score"), "url"))
    return states.where((F.col("status") == "candidate") & (F.col("score") >= least)).withColumn("rank", rank)


def site_memory(scans: DataFrame, repointed: DataFrame) -> DataFrame:
    """What is known of each site that was ever scanned: preferred_tier and how often it has worked, vendor, column roles and
    the last success.

    scans(site_id, page_scan_id, fetched_at, tier, vendor, roles, rows_extracted); repointed(site_id, at). A new address
    starts afresh: scans before it don't count. Without a success the tier is 1, without a vendor it is unknown.
    """
    since = repointed.groupBy("site_id").agg(F.max("at").alias("since"))
    own = scans.join(since, "site_id", "left").withColumn("counts", F.coalesce(F.col("fetched_at") >= F.col("since"), F.lit(True)))
    good = F.col("counts") & (F.col("rows_extracted") > 0)
    last = lambda c, when: F.max_by(c, F.when(when, F.col("page_scan_id")))
    return own.groupBy("site_id").agg(
        F.coalesce(last("tier", good), F.lit(1)).alias("preferred_tier"), F.count_if(good).alias("tier_success_count"),
        F.coalesce(last("vendor", F.col("counts") & F.col("vendor").isNotNull()), F.lit("unknown")).alias("vendor"),
        last("roles", good & F.col("roles").isNotNull()).alias("roles"), F.max(F.when(good, F.col("fetched_at"))).alias("last_success_at"),
    )


def history(bids: DataFrame, scans: DataFrame, *, key: list[str], order: list[Column], n: int = 30) -> DataFrame:
    """The last n values of each key with the date of the page scan that they come from."""
    return newest(bids, key, order, n).join(scans.select("page_scan_id", "fetched_at", F.col("as_of_date").alias("page_as_of")), "page_scan_id")


def gone(log: DataFrame, key: str) -> DataFrame:
    """When each key was last deleted: (key, gone_at) of a log(key, at, deleted). What is written later starts afresh."""
    return log.where("deleted").groupBy(key).agg(F.max("at").alias("gone_at"))


def gone_with(parents: DataFrame, parent: str, children: DataFrame, child: str, own: DataFrame | None = None) -> DataFrame:
    """Deletions spread from parents(parent, gone_at) to their children(child, parent): (child, gone_at), the later of both
    where a child also has one of its own."""
    spread = children.select(child, parent).distinct().join(parents, parent).select(child, "gone_at")
    every = spread if own is None else spread.unionByName(own.select(child, "gone_at"))
    return every.groupBy(child).agg(F.max("gone_at").alias("gone_at"))


def remaining(rows: DataFrame, gone: DataFrame, key: str, at: str = "at") -> DataFrame:
    """Rows that were written after their key was last deleted, or whose key never was; rows without a key stay."""
    return rows.join(gone, key, "left").where(F.coalesce(F.col(at) > F.col("gone_at"), F.lit(True))).drop("gone_at")


def cascade(companies: DataFrame, sites: DataFrame, of_sites: dict[str, DataFrame], *, at: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """What deletions leave: companies(company_id, at, deleted) and sites(site_id, company_id, at, deleted) are logs of writes
    and deletions, of_sites are tables with a site_id and a time (`at`, or as the argument names it), such as scans, bids,
    flags and links. Deleting a company deletes its sites, and deleting a site what hangs on it, as far as it was written
    before; a company or site that is written again is a new one without a past."""
    of_company = gone(companies, "company_id")
    of_site = gone_with(of_company, "company_id", sites, "site_id", gone(sites, "site_id"))
    left = {"companies": remaining(companies.where("NOT deleted"), of_company, "company_id"), "sites": remaining(sites.where("NOT deleted"), of_site, "site_id")}
    return left | {name: remaining(rows, of_site, "site_id", (at or {}).get(name, "at")) for name, rows in of_sites.items()}
