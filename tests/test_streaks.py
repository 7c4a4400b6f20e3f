"""Streaks of equal scans with list state: from a start and from stored scans."""

from pyspark.sql import functions as F

from millrace.streaming import bids

SCHEMA = "site bigint, at string, signature string"


def scans():
    rows = [(s, f"{k:03}", "abc"[(k * (s + 1) // 7) % 3]) for s in range(6) for k in range(40)]
    rows += [(6, "001", None), (6, "002", None), (7, None, "a"), (7, "001", "a"), (8, "001", "a"), (8, "001", "b"), (8, "001", "b")]
    rows += [(9, f"{k:05}", "same") for k in range(3000)]  # a site that has most of the scans
    return rows


def streamed(session, folder, rows, history=None):
    """Streaks after each part of rows, streamed one by one; the last one of each site counts."""
    for n, part in enumerate(rows):
        session.createDataFrame(part, SCHEMA).write.parquet(f"{folder}/in/part={n}")
    stream = session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")
    found = {}

    def keep(batch, number):
        found.update({r.key: r.streak for r in batch.collect()})

    out = bids.resumed_streaks(stream, history, key="site", signature="signature", order=F.col("at"))
    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return found


def expected(rows):
    out = {}
    for site in {r[0] for r in rows}:
        of = sorted(((a, s) for k, a, s in rows if k == site), key=lambda r: tuple((x is not None, x or "") for x in r), reverse=True)[:5]
        out[site] = next((n for n, (_, s) in enumerate(of) if s != of[0][1]), len(of))
    return out


def test_a_start_from_stored_scans_equals_a_replay(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before, session, rows = spark.conf.get(provider), bids.stateful_session(spark), scans()
    assert spark.conf.get(provider) == before != session.conf.get(provider)
    old, new = rows[::2], rows[1::2]
    replay = streamed(session, tmp_path / "replay", [old, new])
    assert replay == expected(rows)
    resumed = streamed(session, tmp_path / "resumed", [new], session.createDataFrame(old, SCHEMA))
    assert resumed == {k: v for k, v in replay.items() if k in {r[0] for r in new}}
    assert streamed(session, tmp_path / "empty", [new], session.createDataFrame([], SCHEMA)) == expected(new)


def test_only_the_newest_stored_scans_are_shuffled(spark):
    history = spark.createDataFrame([(1, f"{k:03}", "a") for k in range(9)], SCHEMA)
    newest = bids.newest_scans(history.withColumnRenamed("site", "key"), 5)
    assert newest.count() == 5 and newest._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
