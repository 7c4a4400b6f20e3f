"""Near duplicates where an id stands at several texts."""

import random

import corpus_pipeline
from millrace.llm import near_dedup
from tests.llm.conftest import prose


def near(text):
    words = text.split()
    words[len(words) // 2] = "changed"
    return " ".join(words)


def rows_of():
    rng = random.Random(11)
    a, b, c, d, e = (prose(rng, 120) for _ in range(5))
    rows = [(5, a), (5, b), (7, near(a)), (9, near(b)), (5, a), (20, c), (21, d), (21, near(c)), (3, e), (21, None), (21, "")]
    return rows, (a, b, c, d, e)


def test_every_text_of_an_id_links_it(spark):
    rows, _ = rows_of()
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(df).collect()}
        assert got == {5: 5, 7: 5, 9: 5, 20: 20, 21: 20, 3: 3}


def test_texts_without_an_id_each_link(spark):
    rows, (a, b, *_) = rows_of()
    df = spark.createDataFrame([(None, a), (None, b), (7, near(a)), (9, near(b)), (3, rows[8][1])], "doc_id long, text string")
    got = {(r.doc_id, r.group_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {(None, None), (7, None), (9, None), (3, 3)}


def test_the_stage_keeps_other_texts_of_a_repeated_id(spark):
    rows, (a, b, c, d, e) = rows_of()
    df = spark.createDataFrame([*rows, (None, c), (None, c)], "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, df, "")
    key = lambda r: (r[0] or -1, r[1] or "", r[1] is None)
    want = [(5, a), (5, b), (20, c), (21, d), (3, e), (21, None), (21, "")]  # rows without an id only stay where no row of the group has one
    assert kept.columns == ["doc_id", "text"] and sorted(map(tuple, kept.collect()), key=key) == sorted(want, key=key)


def test_copies_without_an_id(spark):
    """One row stays of texts that no row with an id has; of a row that is repeated with other columns the least as JSON."""
    rows = [(None, "only without an id", "y"), (None, "only without an id", "x"), (None, None, "p"), (None, None, "p"), (4, "with one", "b"), (4, "with one", "a"), (None, "with one", "c")]
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, other string"), "")
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(None, "only without an id", "x"), (None, None, "p"), (4, "with one", "a")], kept.schema).collect()))
