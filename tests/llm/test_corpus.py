"""Near duplicates, components, repeated strings and the pipeline against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from millrace.llm import minhash, near_dedup, repeats, suffix_dedup
from millrace.llm.components import components
from tests.llm.conftest import prose


ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaders(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame([*edges, (7, 8), (8, 7), (5, 5), (None, 3)], "a long, b long")
    got = {r.id: r.label for r in components(df).collect()}
    ids = {x for e in edges for x in e} | {5}
    assert got == leaders(ids, edges)
    assert components(df.limit(0)).count() == 0


def plain_weights(rows):
    """Distinct texts with their shingles (tuples of words) and weights, from frequencies counted one by one."""
    words = {t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(ASCII)) for t in {r[1] for r in rows if r[1]}}
    tf = {t: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for t, w in words.items()}
    df = Counter(x for _, t, *_ in rows if t for x in tf[t])
    idf = lambda n: 1 + minhash.IDF_RANGE * min(1.0, math.log(n / len(rows)) / math.log(1 / minhash.FREQUENT))
    return {t: {x: (1 + math.log(n)) * idf(df[x]) for x, n in c.items()} for t, c in tf.items()}


def plain_similarity(a, b):
    least = sum(min(a[x], b[x]) for x in a.keys() & b.keys())
    whole = sum(a.values()) + sum(b.values()) - least
    return least / whole if whole else 0.0


def plain_groups(rows):
    texts = {}
    for i, t, *_ in rows:
        if t:
            texts.setdefault(t, []).append(i)
    w = plain_weights(rows)
    links = [(a[0], b) for a in texts.values() for b in a[1:]]
    names = list(texts)
    links += [(texts[x][0], texts[y][0]) for k, x in enumerate(names) for y in names[k + 1 :] if plain_similarity(w[x], w[y]) >= 0.8]
    return leaders([r[0] for r in rows], links)


def test_frequencies(spark, monkeypatch):
    """Exact numbers of documents of each frequent shingle, although shingles share entries, in pieces or at once."""
    rng = random.Random(6)
    rows = [(i, prose(rng, 30) + (" a passage that many of them share word for word" if i % 3 == 0 else "")) for i in range(150)]
    df = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    plain = Counter(x for _, t in rows for x in set(minhash.shingles(t).tolist()))
    for bits, per, held in ((20, 1000, 1 << 20), (8, 30, 64)):
        monkeypatch.setattr(near_dedup, "HELD_SHINGLES", held)
        h, n = near_dedup.frequencies(df, len(rows), bits=bits, one_in=per)
        assert dict(zip(h.tolist(), n.tolist(), strict=True)) == {x: k for x, k in plain.items() if k > len(rows) / per}
        assert (np.diff(h.astype(object)) > 0).all()


def test_groups(spark, docs, corpus, empty):
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs).collect()}
    want = plain_groups(corpus)
    assert got == want and sum(i != g for i, g in got.items()) >= 10
    assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("few", [near_dedup.FEW_PAIRS, 0])
def test_crowded_buckets(spark, monkeypatch, few):
    """A large group of near copies, most of them alike to few others."""
    monkeypatch.setattr(near_dedup, "FEW_PAIRS", few)
    rng = random.Random(9)
    base = prose(rng, 150).split()
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(12)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == plain_groups(rows)


@pytest.mark.parametrize("few", [near_dedup.FEW_PAIRS, 0])
def test_two_families_that_are_no_one(spark, monkeypatch, few):
    """Near copies of two texts that share most of their words: each family is a group, and strangers stay alone."""
    monkeypatch.setattr(near_dedup, "FEW_PAIRS", few)
    rng = random.Random(12)
    shared, own = prose(rng, 150), [prose(rng, 25), prose(rng, 25)]
    rows = []
    for i in range(80):
        words = f"{shared} {own[i % 2]}".split()
        words[150 + rng.randrange(25)] = f"edit{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, f"{shared} {prose(rng, 120)}") for i in range(5)]
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)


def test_group_of_odd_ids(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text), (11, None), (12, ""), (13, ""), (14, "?!"), (15, "?!"), (16, "Word"), (17, "word")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.group_id)) for r in near_dedup.near_duplicates(df).collect())
    assert got == sorted([("None", "None"), ("4", "None"), ("9", "None"), ("11", "11"), ("12", "12"), ("13", "13"), ("14", "14"), ("15", "14"), ("16", "16"), ("17", "16")])


def test_samples_agree_as_similarity():
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    sampler, found = minhash.Sampler(hashes=2048), []
    for cut in (30, 100, 200):
        a = (h[: 300 - cut // 2], np.ones(300 - cut // 2, np.float32))
        b = (h[cut // 2 :], np.full(300 - cut // 2, 1.5, np.float32))
        sig = sampler.signatures([a, b])
        found.append((minhash.jaccard(a, b), float((sig[0] == sig[1]).mean())))
    assert all(abs(x - y) < 0.05 for x, y in found), found


def test_word_hashes_of_long_texts(monkeypatch):
    data = b"ab cd  efg " * 50
    whole = minhash.word_hashes(data)
    monkeypatch.setattr(minhash, "PIECE", 16)
    assert (minhash.word_hashes(data) == whole).all() and len(whole) == 150
    assert len(minhash.word_hashes(b"x" * 100)) == 1 and len(minhash.word_hashes(b"")) == 0


def plain_repeats(rows):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        out.append((i, len(b), int(gone.sum()), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize(("meeting", "chunk", "more"), [(50_000, 1 << 20, {}), (1, 700, {}), (50_000, 700, {"by_gram": 1, "slots": 64, "strings": 50}), (3, 700, {"by_gram": 2, "slots": 1 << 12})])
def test_repeats(spark, corpus, empty, monkeypatch, meeting, chunk, more):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows = [r[:2] for r in corpus] + [(600 + i, prose(rng, rng.randint(0, 30)) + passage[rng.randrange(9) : 200 + rng.randrange(150)] + prose(rng, 20)) for i in range(25)]
    rows += [(700, "ab" * 400), (701, passage[:99]), (702, "é" * 120), (703, "x" + "é" * 120), (704, passage * 3)]
    rows.sort(key=lambda r: r[0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_repeats(rows)
    got = sorted(suffix_dedup.remove_repeats(df, meeting=meeting, **more).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_bytes, r.n_removed, [(x.start, x.end) for x in r.spans], bytes(r.kept)) for r in got] == want
    short = sorted(suffix_dedup.remove_repeats(df, meeting=meeting, digest=True, **more).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_spans, r.kept_sha256) for r in short] == [(i, len(s), hashlib.sha256(k).hexdigest()) for i, _, _, s, k in want]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_strings_with_one_hash_are_told_apart(monkeypatch):
    """Where two strings share a hash, their bytes decide."""
    data = [bytes([65 + k % 3]) * 100 + b"x" for k in range(6)]
    whole = pa.table({"gram": [1] * 6, "doc": list(range(6)), "chunk": [0] * 6, "pos": [200 * k for k in range(6)], "n": [2] * 6, "data": data})
    plain = [(b.column("pos").to_pylist(), b.column("n").to_pylist()) for b in suffix_dedup._repeated(whole)]
    monkeypatch.setattr(suffix_dedup, "mixed", lambda h: h * np.uint64(0))
    assert [(b.column("pos").to_pylist(), b.column("n").to_pylist()) for b in suffix_dedup._repeated(whole)] == plain == [([600, 800, 1000], [2, 2, 2])]


def test_repeats_of_odd_ids(spark):
    text = "0123456789" * 5 + "abcdefghij" * 6
    df = spark.createDataFrame([(3, text), (None, text), (3, text)], "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id or -1), r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(-1, 0), (3, 110), (3, 110)]


def test_segments_don_t_matter(monkeypatch):
    data = np.frombuffer((prose(random.Random(1), 400) * 2).encode(), np.uint8)
    ends = np.array([len(data) // 2, len(data)])

    def starts():
        first, n, gram, cover = repeats.anchors(data, ends)
        return {p + k: g for p, m, g in zip(first.tolist(), n.tolist(), gram.tolist(), strict=True) for k in range(m)}

    whole = starts()
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    assert starts() == whole and len(whole) == len(data) - 2 * 99


def test_pipeline(spark, corpus, tmp_path):
    """Each stage over what the one before kept, against what the operators' plain versions say."""
    from tests.llm.test_rows import plain_contamination

    rng = random.Random(3)
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in corpus]
    rows += [(800 + i, prose(rng, 40), "en", "s0", 0) for i in range(30)]
    question = prose(rng, 20)
    rows += [(850, prose(rng, 10) + " " + question, "en", "s1", 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    known = by_name["language_id"](spark, docs, str(tmp_path))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert known.columns == docs.columns
    assert ids(docs) - ids(known) >= {400, 401, 402, 405} and ids(known) >= {r[0] for r in rows if r[0] < 400}
    known = spark.createDataFrame(known.collect(), columns)
    once = by_name["near_dedup"](spark, known, str(tmp_path))
    groups = plain_groups([(r.doc_id, r.text) for r in known.collect()])
    assert once.columns == docs.columns and ids(once) == {i for i, g in groups.items() if i == g} and once.count() == len(ids(once))
    once = spark.createDataFrame(once.collect(), columns)
    clean = by_name["decontaminate"](spark, once, str(tmp_path))
    bad = {r.doc_id for r in once.collect() for n, hit, _ in [plain_contamination(r.text, [(1, question)])] if hit and 20 * hit >= n}
    assert bad == {850} and ids(clean) == ids(once) - bad
    mixed = by_name["mixing"](spark, clean, str(tmp_path))
    assert mixed.columns == docs.columns and ids(mixed) == ids(clean)
    mixed = spark.createDataFrame(mixed.collect(), columns)
    tokens = by_name["token_store"](spark, mixed, str(tmp_path)).orderBy("start").collect()
    assert len(tokens) == mixed.count() and [r.doc_id for r in tokens] == sorted(r.doc_id for r in mixed.collect())
    assert [r.start for r in tokens] == [0, *np.cumsum([r.n_tokens for r in tokens])[:-1].tolist()]
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in done.collect()} == ids(clean)


def test_pipeline_with_clashing_names_and_empty_tables(spark, corpus, tmp_path):
    from pyspark.sql import functions as F

    names = ["mix_source", "mix_at", "__nth", "__key", "row", "id", "key", "nth", "source_", "block", "at", "bits", "n_words", "spans", "dotted.name"]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in corpus] + [(None, "the grain of the field", "en", None, 1), (3, "Another text of it.", "en", None, 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({n: F.lit(7) for n in names}).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    df.write.parquet(f"{tmp_path}/all/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    bench = spark.createDataFrame([(1, corpus[3][1]), (None, None), (2, "")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/all/benchmark.parquet")
    bench.limit(0).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    for part in ("all", "none"):
        docs = spark.read.parquet(f"{tmp_path}/{part}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, f"{tmp_path}/{part}")
            assert out.columns == docs.columns, name
            assert out.where("mix_source <> 7 OR `dotted.name` <> 7").count() == 0
            left = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
            assert (None, "the grain of the field") in left or part == "none", name
            assert (3, "Another text of it.") in left or part == "none", name
        n = corpus_pipeline.run(spark, f"{tmp_path}/{part}").count()
        assert n == 0 if part == "none" else n >= 40
