"""The registered queries over one small corpus: columns, types, and results against plain Python."""

import hashlib
import re
from collections import Counter

import pytest

import __spark_entry__
from tests.llm.test_corpus import plain_groups, plain_repeats
from tests.llm.test_rows import plain_contamination

LONG = "the grain of the field and the light of the market " * 4000
WANT = {
    "op1_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op3_token_store": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op4_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_mixing": {"doc_id": "bigint", "mix_source": "string", "mix_weight": "double"},
    "op6_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op7_near_dedup": {"doc_id": "bigint", "group_id": "bigint"},
    "op8_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
}


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    """The corpus with a very long text, and tables without rows beside it."""
    path = tmp_path_factory.mktemp("tables")
    rows = [*corpus, (500, LONG, "en", "s0"), (501, LONG[:50_000] + "end", "en", "s0")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(f"{path}/all/documents.parquet")
    spark.createDataFrame([(1, corpus[3][1]), (2, None)], "item_id long, text string").write.parquet(f"{path}/all/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/all/labels.parquet")
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{path}/all/{name}.parquet").limit(0).write.parquet(f"{path}/none/{name}.parquet")
    return str(path), rows


@pytest.mark.parametrize("name", WANT)
def test_columns_and_rows(spark, tables, name):
    path, rows = tables
    got = __spark_entry__.queries()[name](spark, f"{path}/all")
    assert WANT[name].items() <= dict(got.dtypes).items()
    found = got.collect()
    by_id = {r.doc_id: r for r in found}
    assert by_id.keys() == {r[0] for r in rows} and (name == "op5_mixing" or len(found) == len(rows))
    assert __spark_entry__.queries()[name](spark, f"{path}/none").count() == 0
    if name == "op2_decontaminate":
        plain = {i: plain_contamination(t, [(1, rows[3][1])]) for i, t, *_ in rows}
        assert {i: (r.n_words, r.n_hit, r.n_items) for i, r in by_id.items()} == {i: (n, hit, len(items)) for i, (n, hit, items) in plain.items()}
        assert all(r.items_sha256 == hashlib.sha256(b"1" * r.n_items).hexdigest() for r in found)
    if name == "op5_mixing":
        reads, words = Counter(r.doc_id for r in found), {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
        assert max(reads.values()) <= 5 and min(reads.values()) == 1
        share = Counter()
        for r in found:
            share[r.mix_source] += words[r.doc_id]
        weight = {r.mix_source: r.mix_weight for r in found}
        assert abs(sum(weight.values()) - 1) < 1e-9 and share.keys() == weight.keys()
    if name == "op7_near_dedup":
        assert {i: r.group_id for i, r in by_id.items()} == plain_groups(rows)
    if name == "op10_suffix_dedup":
        want = plain_repeats(sorted((i, t) for i, t, *_ in rows))
        assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id.items()} == {i: (n, gone, len(spans), hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in want}
