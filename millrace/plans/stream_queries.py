"""Streaming queries: each reads a table as a stream, to its end, and returns what stands then."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.plans.relational_queries import _STREAK
from millrace.session import table
from millrace.streaming import bids


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a local one only for a local master that has no shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


@query(
    "q37_stream_supersede",
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def q37_stream_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    bids.append_stream(_events(spark, sf_dir), f"{at}/log", f"{at}/state")
    log = spark.read.parquet(f"{at}/log")
    return bids.current(log, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("q38_stream_streak", _STREAK)
def q38_stream_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    order = F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    found = bids.streaks(_events(spark, sf_dir), key="user_id", signature="event_type", order=order)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/part={number}")

    found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    return bids.current(rows, ["key"], [F.desc("batch")]).select(F.col("key").alias("user_id"), "streak")


@query("q79_resumed_streak", f"SELECT * FROM ({_STREAK}) WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 3 = 0)")
def q79_resumed_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three events are stored, the third is streamed: users of streamed ones have the streak of all their events."""
    at = _folder(spark)
    order = F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    session = bids.stateful_session(spark)
    stored = table(session, sf_dir, "events").where("event_id % 3 <> 0")
    found = bids.resumed_streaks(_events(session, sf_dir).where("event_id % 3 = 0"), stored, key="user_id", signature="event_type", order=order)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/part={number}")

    found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    return bids.current(rows, ["key"], [F.desc("batch")]).select(F.col("key").alias("user_id"), "streak")
