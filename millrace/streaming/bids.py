"""Incremental collection with Structured Streaming: newest per identity, and streaks of equal scans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import store


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what has arrived to a Parquet log, once: the batch's number names its folder, so a repeated batch replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key in a log: what arrives late wins or loses by `order`, not by when it came."""
    return store.newest(log, key, order)


STREAK = "key bigint, streak bigint"
_STATE = "recent array<struct<order:string,signature:string>>"


def streaks(stream: DataFrame, *, key: str, signature: str, order: Column, limit: int = 5) -> DataFrame:
    """For each key in a batch: how many of its newest `limit` scans so far have the newest one's signature.

    State per key: its newest scans, never more than `limit`.
    """

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = [tuple(r) for r in state.get[0]] if state.exists else []
        for part in parts:
            recent = sorted([*recent, *zip(part["order"], part["signature"], strict=True)], reverse=True)[:limit]
        state.update(([{"order": o, "signature": s} for o, s in recent],))
        same = next((n for n, (_, s) in enumerate(recent) if s != recent[0][1]), len(recent))
        yield pd.DataFrame({"key": [k[0]], "streak": [same]})

    rows = stream.select(F.col(key).alias("key"), F.col(signature).alias("signature"), order.alias("order"))
    return rows.groupBy("key").applyInPandasWithState(update, STREAK, _STATE, "update", GroupStateTimeout.NoTimeout)


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB, as list state needs; the caller's settings stay."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled", "spark.checkpoint.dir"):
        value = spark.conf.get(name, None)
        if value is not None and own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


class _Streak(StatefulProcessor):
    """List state of a key: its newest scans as (at, signature), the newest first, never more than `limit`."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at string, signature string")

    def _add(self, parts: Iterable[pd.DataFrame]) -> list[tuple]:
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        for part in parts:
            new = zip(*(part[c].astype(object).where(part[c].notna(), None) for c in ("at", "signature")), strict=True)
            rank = lambda r: tuple((x is not None, x or "") for x in r)  # noqa: E731  nulls are the oldest
            recent = sorted([*recent, *new], key=rank, reverse=True)[: self.limit]
        self.recent.put(recent)
        return recent

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        recent = self._add(rows)
        same = next((n for n, (_, s) in enumerate(recent) if s != recent[0][1]), len(recent))
        yield pd.DataFrame({"key": [key[0]], "streak": [same]})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self._add([initialState])

    def close(self) -> None:
        pass


def newest_scans(scans: DataFrame, limit: int) -> DataFrame:
    """The newest `limit` rows (key, signature, at) of each key: a task passes on no more of a key than these."""
    newest = Window.partitionBy("key").orderBy(F.desc_nulls_last("at"), F.desc_nulls_last("signature"))
    return scans.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= limit).drop("nth")


def resumed_streaks(stream: DataFrame, history: DataFrame | None = None, *, key: str, signature: str, order: Column, limit: int = 5) -> DataFrame:
    """As `streaks`, for a stream of a `stateful_session`; scans that are stored already stand in `history` (columns as the
    stream's) and count as if they had been streamed, so a new checkpoint starts from them instead of a replay.

    Of the history, Spark chooses each key's newest `limit` scans before they become state. Null orders are the oldest scans; null signatures equal each other; of scans of equal
    order the greater signature is the newer one. Keys of the history alone give no row.
    """
    pick = lambda df: df.select(F.col(key).alias("key"), F.col(signature).cast("string").alias("signature"), order.cast("string").alias("at"))
    start = None if history is None else newest_scans(pick(history), limit).groupBy("key")
    return pick(stream).groupBy("key").transformWithStateInPandas(_Streak(limit), STREAK, "update", "none", start)
