"""Queries over stored streams, rendered pages and workbook rows equal their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from millrace.plans import catalog

SMALL = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["q79_resumed_streak", "q80_basis_or_change", "q81_page_score", "q82_scan", "q83_workbook_rows"])
def test_equals_sql(spark, name):
    found = catalog.QUERIES[name](spark, str(SMALL))
    with duckdb.connect() as db:
        for path in SMALL.glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        wanted = db.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    plain = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert wanted and plain(found.collect()) == plain(wanted)
