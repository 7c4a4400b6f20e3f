"""Append-only tables, runs that count as a whole, and the views on them: newest per key, history, upserts, tombstones."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BID_KEY, BID_NEWEST = ["row_hash"], ["page_scan_id", "bid_id"]


def newest(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each key by `order`."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= n).drop("__nth")


def latest_bids(bids: DataFrame) -> DataFrame:
    """The newest bid of each identity, over all runs: filters for a run come after, so what a later run replaced is gone."""
    return newest(bids, BID_KEY, [F.desc(c) for c in BID_NEWEST])


def query_bids(
    bids: DataFrame, page_scans: DataFrame, companies: DataFrame, sites: DataFrame, *, run_id: int | None = None,
    company_ids: list[int] | None = None, commodities: list[str] | None = None, latest_only: bool = True,
) -> DataFrame:
    """Bids with the names of their company and site and their page's date. Empty lists don't filter."""
    rows = latest_bids(bids) if latest_only else bids
    rows = rows.join(page_scans.select("page_scan_id", "run_id", F.col("as_of_date").alias("page_as_of")), "page_scan_id")
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    if company_ids:
        rows = rows.where(F.col("company_id").isin(company_ids))
    if commodities:
        rows = rows.where(F.col("commodity").isin(commodities))
    return rows.join(companies.select("company_id", F.col("name").alias("company_name")), "company_id").join(
        sites.select("site_id", F.col("label").alias("site_label"), F.col("url").alias("site_url")), "site_id"
    )


def upsert_view(log: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key in a log of writes, with when the key was first and last seen."""
    rest = [c for c in log.columns if c not in (*key, at)]
    return log.groupBy(*key).agg(
        F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.max_by(F.struct(*rest), F.struct(at, tie)).alias("row")
    ).select(*key, "first_seen_at", "last_seen_at", "row.*")


#: Tables that a run writes as a whole; others are logs.
RUN_TABLES = ("fetched", "bids", "page_scans", "flags", "links")
COMMIT = "run_id long, attempts array<string>, status string, seq long"


def newest_commits(log: DataFrame) -> DataFrame:
    """The newest commit of each run in a log(run_id, attempts, status, seq): run_id, attempts, status."""
    return log.groupBy("run_id").agg(F.max_by(F.struct("attempts", "status"), "seq").alias("c")).select("run_id", "c.*")


def committed(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Of rows(run_id, attempt, ..) those whose attempt the commit of their run names, without the attempt."""
    live = commits.select("run_id", F.explode("attempts").alias("attempt"))
    return rows.join(live, ["run_id", "attempt"], "left_semi").drop("attempt")


class Store:
    """Parquet tables in a folder that all executors share.

    Logs are appended to; deletions in them are rows with `deleted` set. What a run writes goes to folders of its own
    attempt, one for each table, and counts when a row of the commit log names the attempt: that row is one file, which is
    there or not. So readers see a run whole or not at all; a repeated run takes the place of its first writing, also where
    it now has no rows; and what a killed job left behind is never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def begin(self, run_id: int) -> Run:
        return Run(self, run_id)

    def commits(self) -> DataFrame:
        """The newest commit of each run: run_id, attempts, status."""
        return newest_commits(self._read("commits", COMMIT))

    def table(self, name: str) -> DataFrame:
        """All rows of a log, or the committed ones of what runs have written."""
        if name not in RUN_TABLES:
            return self.spark.read.parquet(f"{self.path}/{name}")
        return committed(self.spark.read.parquet(f"{self.path}/runs/{name}"), self.commits())

    def current(self, name: str, key: list[str], order: list[Column]) -> DataFrame:
        """The newest row of each key, without keys whose newest row is a deletion."""
        return newest(self.table(name), key, order).where("NOT coalesce(deleted, false)")

    def compact(self, upto: int) -> None:
        """Writes the runs up to that number together, as few files, and has the commit log name these instead."""
        old = self.commits().where(F.col("run_id") <= upto)
        attempt = _attempt()
        for name in RUN_TABLES:
            if self._there(f"runs/{name}"):
                self.table(name).where(F.col("run_id") <= upto).repartition("run_id").write.mode("overwrite").parquet(f"{self.path}/runs/{name}/attempt={attempt}")
        self._commit(old.select("run_id", F.array(F.lit(attempt)).alias("attempts"), "status"))

    def unnamed(self, name: str) -> list[str]:
        """Folders with rows of a run table that no commit names: what was replaced, compacted or left behind, and may be removed if no
        run is being written."""
        held = self.spark.read.parquet(f"{self.path}/runs/{name}").select("attempt").distinct()
        live = self.commits().select(F.explode("attempts").alias("attempt"))
        return [f"{self.path}/runs/{name}/attempt={r.attempt}" for r in held.join(live, "attempt", "left_anti").orderBy("attempt").collect()]

    def _commit(self, rows: DataFrame) -> None:
        rows.withColumn("seq", F.lit(time.time_ns())).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _there(self, name: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return False
        return True

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._there(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")


def _attempt() -> str:
    return f"a{uuid.uuid4().hex}"


class Run:
    """What is written of a run, in one part or more; only what was put before a commit can be seen after it."""

    def __init__(self, store: Store, run_id: int):
        self.store, self.run_id, self.attempts = store, run_id, [_attempt()]

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes rows of the present part once, and gives what was written: whatever made them is not run again."""
        if name not in RUN_TABLES:
            raise ValueError(f"no table of runs: {name}")
        path = f"{self.store.path}/runs/{name}/attempt={self.attempts[-1]}"
        rows.withColumn("run_id", F.lit(self.run_id).cast("long")).write.mode("overwrite").parquet(path)
        return self.store.spark.read.parquet(path)

    def step(self, rows: DataFrame) -> DataFrame:
        """Writes what later steps share, and gives what was written: plans begin anew there. It is no part of the run, and the
        folder may go when the run is committed."""
        path = f"{self.store.path}/steps/{_attempt()}"
        rows.write.parquet(path)
        return self.store.spark.read.parquet(path)

    def part(self) -> None:
        """Begins another part."""
        self.attempts.append(_attempt())

    def drop_part(self) -> None:
        """Leaves out what was put in the present part."""
        self.attempts.pop()

    def commit(self, status: str) -> None:
        self.store._commit(self.store.spark.createDataFrame([(self.run_id, self.attempts, status)], "run_id long, attempts array<string>, status string"))
