"""A whole run over the sites that are on: robots texts, fetching, reading, links and what is remembered of each site."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import host
from millrace.operators import quality, registry, scan
from millrace.operators.store import Run, Store
from millrace.sources import fetch

#: Sites that are fetched and stored together; a run that is stopped keeps what was stored before.
BATCH_SITES = 2000
ROBOTS = "domain string, body string, fetched_at timestamp"


def run_tag(run_id: int) -> str:
    return f"run-{run_id}"


def cancel(spark: SparkSession, run_id: int) -> None:
    """Stops the jobs of a run, from another thread than the one that collects."""
    spark.sparkContext.cancelJobsWithTag(run_tag(run_id))


def robots_of(store: Store, sites: DataFrame, transport: str, now: Column, *, hours: int = fetch.ROBOTS_HOURS, **options: object) -> DataFrame:
    """Robots texts (domain, body) of the domains of sites(url): from the log if younger than `hours`, else fetched and logged."""
    domains = sites.select(host(F.col("url")).alias("domain"), F.lower(F.regexp_extract("url", "^([a-zA-Z]+)://", 1)).alias("scheme")).groupBy("domain").agg(F.max(F.nullif("scheme", F.lit(""))).alias("scheme"))
    log = lambda: store._read("robots", ROBOTS)
    asked = lambda: fetch.robots_as_of(domains.withColumn("at", now), log(), hours)
    missing = asked().where("NOT known").select("domain").join(domains, "domain")
    got = fetch.fetch_robots(missing, transport, now, **options)
    store.append("robots", got.select("domain", "body", F.col("fetched_at").cast("timestamp").alias("fetched_at")))
    return asked().select("domain", "body")


def pages_of(sites: DataFrame, robots: DataFrame, transport: str, agent: str, now: Column, **options: object) -> DataFrame:
    """What a scan reads: site_id, status, html, error, fetched_at. Sites that robots texts keep out are not fetched."""
    may = fetch.allowed(sites.select("url").distinct(), robots, agent)
    got = fetch.fetch_pages(may, transport, **options)
    kept_out = F.when(F.col("seen").isNull(), "ROBOTS_BLOCKED")
    return sites.select("site_id", "url").join(got.withColumn("seen", F.lit(True)), "url", "left").select("site_id", "status", "html", F.coalesce("error", kept_out).alias("error"), now.alias("fetched_at"))


def collect(
    store: Store, sites: DataFrame, companies: DataFrame, run_id: int, transport: str, *, today: Column, now: Column, agent: str = "millrace", thresholds: dict | None = None,
    renderer: scan.Renderer | None = None, stop: Callable[[], bool] | None = None, batch_sites: int = BATCH_SITES, **options: object,
) -> DataFrame:
    """One run over sites(site_id, company_id, url, label, enabled) and companies(company_id, archived): its totals and status.

    Companies are dealt into batches. Each batch is fetched, read, stored and committed, so that what was done counts
    whatever comes after. `stop` is asked between batches, and when jobs were stopped by cancel(): the run ends as partial,
    without the batch that was begun. Options go to the fetching of pages (politeness, pauses).
    """
    spark = store.spark
    live = registry.enabled_sites(sites, companies)
    batches = max(1, -(-live.count() // batch_sites))
    run, stopped, done = store.begin(run_id), False, None
    spark.sparkContext.addJobTag(run_tag(run_id))
    try:
        for k in range(batches):
            if stop is not None and stop():
                stopped = True
                break
            if done is not None:
                run.part()
            try:
                done = _batch(store, run, live.where(F.pmod(F.xxhash64("company_id"), F.lit(batches)) == k), transport, done, today=today, now=now, agent=agent, thresholds=thresholds, renderer=renderer, options=options)
            except Exception:
                if stop is None or not stop():
                    raise
                run.drop_part()
                stopped = True
                break
            run.commit("running")
    finally:
        spark.sparkContext.removeJobTag(run_tag(run_id))
    if done is None:
        done = spark.createDataFrame([], "run_id long, pages long, rows long, flags long, status string")
    totals = done.groupBy("run_id").agg(
        F.sum("pages").alias("pages"), F.sum("rows").alias("rows"), F.sum("flags").alias("flags"), F.when(F.lit(stopped) | F.bool_or(F.col("status") == "partial"), "partial").otherwise("complete").alias("status")
    )
    first = totals.first()
    run.commit(first.status if first else "partial" if stopped else "complete")
    return totals


def _batch(store: Store, run: Run, sites: DataFrame, transport: str, done: DataFrame | None, *, today, now, agent, thresholds, renderer, options) -> DataFrame:
    robots = robots_of(store, sites, transport, now, **options)
    pages = pages_of(sites, robots, transport, agent, now, **options)
    told = quality.run_status(scan.write_part(run, pages, sites, today, now, thresholds, renderer=renderer))
    return told if done is None else done.unionByName(told)


def memory(store: Store, repointed: DataFrame) -> DataFrame:
    """What all runs so far tell of each site (see registry.site_memory)."""
    return registry.site_memory(store.table("page_scans"), repointed)


def links(store: Store, marked: DataFrame) -> DataFrame:
    """Links that were found on pages with bids, with what they were marked as (see registry.link_states)."""
    return registry.link_states(store.table("links"), marked)
