"""Mixing where one row is most of a source: its copies are dealt over blocks like other rows, and none is lost."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


@pytest.mark.parametrize("whole", [False, True])
def test_copies_of_a_row_are_dealt_over_blocks(spark, monkeypatch, whole):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 16)
    monkeypatch.setattr(mixing, "RUN", 10)
    k = F.col("id")
    docs = spark.range(900).select(
        F.when(k >= 300, 7).when(k % 10 != 0, k).alias("doc_id"), F.when(k >= 300, "the same words").otherwise(F.concat(F.lit("words of "), k.cast("string"))).alias("text"),
        F.when(k % 2 == 0, "big").otherwise("small").alias("source"), F.lit(1).alias("row"), F.lit(2).alias("h"),
    )
    found = mixing.mix_sources(docs, whole_rows=whole)
    rows = found.select("row.*" if whole else "doc_id", "mix_source", "mix_epoch", "mix_block", "mix_place").collect()
    first = [r for r in rows if r.mix_epoch == 0]
    assert Counter((r.doc_id, r.mix_source) for r in first) == Counter((r.doc_id, r.source) for r in docs.collect())
    sizes = Counter((r.mix_source, r.mix_block) for r in first)
    assert max(sizes.values()) < 40 and len(sizes) > 60  # 57 buckets of some 16 rows, of two sources
    assert len({(r.mix_source, r.mix_epoch, r.mix_block, r.mix_place) for r in rows}) == len(rows)
    again = mixing.mix_sources(docs.repartition(3), whole_rows=whole)
    key = lambda r: (r.mix_source, r.mix_epoch, r.mix_block, r.mix_place)
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))


def test_maps_go_along_undealt(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 4)
    docs = spark.range(30).select(F.lit(1).alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    found = mixing.mix_sources(docs, whole_rows=True).select("row.m").collect()
    assert sorted(r.m["k"] for r in found) == list(range(30))
