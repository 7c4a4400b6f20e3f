"""A site whose bids are all for February of a common year is flagged by the end of that month, as in the SQL of q82_scan."""

from datetime import datetime

import duckdb

from millrace.plans import catalog


def test_february_ends(spark, tmp_path):
    orders = [(1, 1, datetime(1997, 2, 3)), (2, 2, datetime(2000, 2, 5)), (3, 3, datetime(2001, 2, 7)), (4, 3, datetime(1999, 2, 9)), (5, 4, datetime(1997, 2, 11)), (6, 4, datetime(2001, 8, 1))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, 1) for k in range(1, 6)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    found = catalog.QUERIES["q82_scan"](spark, str(tmp_path))
    with duckdb.connect() as db:
        for name in ("orders", "customer"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        wanted = sorted(db.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLES['q82_scan']})").fetchall())
    assert [r[4] for r in wanted] == ["STALE_ASOF,STALE_DELIVERY"] * 2 + ["STALE_DELIVERY", "", "NO_BID_DATA"]
    assert sorted(map(tuple, found.collect())) == wanted
