"""Spelling variants, the piece codec and hard negatives against plain Python and the library."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.llm import hard_negatives, piece_codec, variants
from tests.llm.conftest import prose


def saved(spark, folder, name, df):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


# spelling variants


def plain_words(rows, spoil=None, least_length=7, least_count=2):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n, factor=10):
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= factor * n[w]}

    def last(w):
        return last(form[w]) if w in form else w

    return sorted((w, form.get(w), last(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def noisy(rng, words, n):
    letters = "abcéÿz"
    out = []
    for _ in range(n):
        w = rng.choice(words)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
        out.append(w if rng.random() < 0.8 else w.upper())
    return out


def test_variants_as_plain(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    base = ["elevator", "éléments", "delivery", "harvest", "marketer", "aaaaaaa", "aaaaaaaa", "straße"]
    rows = [(i, rng.choice([" ", "-", "1", "東", "\n"]).join(noisy(rng, base, rng.randrange(60)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "123 !?"), (None, "elevator Elevator"), (7, rows[7][1]), (7, rows[7][1]), (903, "× ÷ elevato× " * 30), (904, "harvest " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in ("key", "word", "n", "doc", "size", "first")})
    want = plain_variants(plain_words(rows, variants.SPOIL))
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)
    monkeypatch.setattr(variants, "HELD_WORDS", 50)
    got = __spark_entry__.queries()["op11_spelling_variants"](spark, saved(spark, tmp_path, "documents", df))
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert sorted(map(tuple, got.collect())) == want
    assert variants.spelling_variants(variants.word_counts(df.limit(0))).count() == 0


def test_chains_and_ties_of_variants(spark):
    n = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 19_999, "abcdefx": 20, "qqqqqqq": 5, "qqqqqqqq": 50, "qqqqqqqqq": 50, "zzzzzzz": 9}
    df = spark.createDataFrame([*n.items(), ("zzzzzzz", 3), (None, 4)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near) for r in variants.spelling_variants(df).collect()}
    assert got == {w: (f, r, k) for w, f, r, _, k, _ in plain_variants(n)}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij", 2) and got["abcdefghij"] == (None, "abcdefghij", 2)


# pieces


@pytest.fixture(scope="module")
def coder():
    return piece_codec.PieceModel(piece_codec.model_path())


def odd_texts():
    rng = random.Random(1)
    texts = ["", "a", " ", "  a  b ", "x\ny", "東京 \U0001f600 é", "▁ ▁x", "</s><s><unk><0x41>", "a" * 300, "\0a b", "tab\tx   y", "ß" * 50 + " " * 70, "è�", "x" * 20_000 + " " + "the " * 20_000]
    return texts + ["".join(rng.choice("abcdehrt  ▁\n.é東\U0001f600\0") for _ in range(rng.randrange(40))) for _ in range(500)]


def test_ids_and_spans_as_the_library(coder, monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_STRETCHES", 20)
    for text in odd_texts():
        ids, starts, ends, printed = coder.encode(text)
        pieces = coder.library.encode(text, return_type="proto").pieces
        assert list(zip(ids[:-1], starts[:-1].tolist(), ends[:-1].tolist(), strict=True)) == [(p.id, p.begin, p.end) for p in pieces]
        assert ids[-1] == coder.end and printed == " ".join(map(str, ids)) and starts[-1] == ends[-1] == len(text.encode())
        assert b"".join(text.encode()[a:b] for a, b in zip(starts, ends, strict=True)) == text.encode()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf", "identity"])
def test_compiled_maps_as_the_library(rule):
    """Longest prefixes of other maps than the model's own, and blanks that are squeezed, with their places."""
    from sentencepiece import SentencePieceNormalizer, sentencepiece_model_pb2

    rng = random.Random(2)
    texts = ["", "  ", "ＫＡＤＯＫＡＷＡ ㍿ x", "ﬁne ½ cup", " a　b\tc ", "éÉ ǅ ß İ", "​x­ ゙が"] + ["".join(rng.choice("aB ㍿ﬁ́é\t　½ｶﾞß") for _ in range(rng.randrange(30))) for _ in range(300)]
    for prefix, squeeze, escape in ((False, False, False), (True, True, True), (True, False, True)):
        library = SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=escape)
        spec = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
        assert (len(piece_codec.compiled_map(spec.precompiled_charsmap)) > 1000) == (rule != "identity")
        ours = piece_codec.Normaliser(spec)
        for text in texts:
            plain, steps, skipped = ours(text)
            assert plain == library.normalize(text), (rule, text)
            bounds = np.cumsum([0, *(len(c.encode()) for c in plain)])[:-1]
            back = steps[0].back(bounds) + skipped
            for s in steps[1:]:
                back = s.back(back)
            want = [len(text[:k].encode()) for k in library.normalize(text, with_offsets=True)[1]]
            first = 1 if prefix and plain else 0  # where the mark before a text is said to be is a matter of taste
            assert back.tolist()[first:] == want[first : len(bounds)], (rule, text)


def test_codec_query(spark, coder, corpus, docs, empty, tmp_path):
    rows = [(r[0], r[1]) for r in corpus] + [(None, "x"), (3, "again"), (3, "again")]
    df = docs.unionByName(spark.createDataFrame([(None, "x"), (3, "again"), (3, "again")], "doc_id long, text string"), allowMissingColumns=True)
    got = __spark_entry__.queries()["op12_piece_codec"](spark, saved(spark, tmp_path, "documents", df))
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc, text in rows:
        ids = coder.library.encode(text or "", add_eos=True)
        want.append((str(doc), len(ids), sha(" ".join(map(str, ids))), sha(coder.library.decode(ids))))
    assert sorted((str(r[0]), *r[1:4]) for r in got.collect()) == sorted(want)
    whole = {r.doc_id: r for r in piece_codec.encode_documents(docs, piece_codec.model_path()).collect()}
    assert whole[401].ids == whole[400].ids == [2] and whole[401].starts == [0] and whole[403].ends[-1] == len(dict(rows)[403].encode())
    spans = [(r.doc_id, zlib.crc32(struct.pack(f"<{2 * r.n_tokens}q", *r.starts, *r.ends))) for r in whole.values()]
    assert set(spans) <= {(r.doc_id, r.spans_crc32) for r in got.collect()}
    assert piece_codec.encode_documents(empty, piece_codec.model_path()).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(open(piece_codec.model_path(), "rb").read())
    model.pieces[1000].type = 4  # user-defined
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        piece_codec.PieceModel(str(tmp_path / "m"))


# hard negatives


def plain_negatives(rows, anchors_each=50):
    kept = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        kept.append((i, [math.floor(256 * float(np.float32(v))) for v in x], label))
    out = []
    for a, ax, al in kept:
        if a % anchors_each:
            continue
        scored = sorted((-sum(p * q for p, q in zip(ax, x, strict=False)), i, label) for i, x, label in kept)
        for s, p, _ in [r for r in scored if r[2] == al and r[1] != a][:5]:
            found = [r for r in scored if r[2] != al and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(found)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_negatives_as_plain(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.2, (700, 8)).astype(np.float32)
    x[100:300] = x[100]  # a large group of copies: scores are ties
    rows = [(i, x[i].tolist(), int(rng.integers(0, 3)) if i % 3 else 1) for i in range(700)]
    rows += [(1000, None, 1), (1001, [0.1] * 8, None), (1050, [0.1] * 7 + [float("nan")], 1), (1100, [float("inf")] * 8, 1), (1101, [None] + [0.2] * 7, 1), (None, [0.3] * 8, 1), (1150, [0.5] * 3, 2), (1151, [], 1), (1200, [], 1), (1250, [-0.4] * 8, -3)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({c: F.lit("z") for c in ("id", "x", "score", "anchor", "nth", "rank")})
    for block, sort, tile in ((8 << 20, 1 << 15, 64), (8 * 8 * 6, 16, 3)):
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
        monkeypatch.setattr(hard_negatives, "SORT_ROWS", sort)
        monkeypatch.setattr(hard_negatives, "TILE", tile)
        got = __spark_entry__.queries()["op13_hard_negatives"](spark, saved(spark, tmp_path, "embeddings", df))
        assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
        assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    assert len(plain_negatives(rows)) > 60


def test_negatives_of_odd_tables(spark):
    ask = lambda rows: hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("id") % 50 == 0)
    assert ask([]).count() == 0 and ask([(1, [1.0], 1)]).count() == 0 and ask([(50, [1.0], 1)]).count() == 0
    # repeated anchors each have their results, repeated rows are rows of their own
    rows = [(50, [1.0], 1), (50, [1.0], 1), (51, [1.0], 1), (52, [0.75], 2), (52, [0.75], 2)]
    assert sorted(map(tuple, ask(rows).collect())) == [(50, 51, 1, 52, 65536, 49152)] * 2 + [(50, 51, 2, 52, 65536, 49152)] * 2
    # no overflow: beyond 64 bits scores are held there
    far = [(50, [3e38], 1), (51, [3e38], 1), (52, [1e16], 2), (53, [1.0], 2)]
    assert [tuple(r)[:4] for r in ask(far).collect()] == []


def test_scores_of_any_size():
    rng = np.random.default_rng(3)
    for top in (2**8, 2**28, 2**40):
        a, b = rng.integers(-top, top, (4, 5)), rng.integers(-top, top, (6, 5))
        got, bound = hard_negatives.scores(a, b)
        want = np.clip(a.astype(object) @ b.astype(object).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)
        assert (got == want).all() and int(abs(got.astype(object)).max()) <= bound
        ids = np.arange(6) * 10
        takes = rng.random((4, 6)) < 0.7
        line = hard_negatives.Sorted(got, bound, ids, takes)
        for k in range(4):
            want = sorted((-int(got[k, j]), int(ids[j])) for j in range(6) if takes[k, j])
            i, s = line.read(k, np.array([2**63 - 1]), np.array([-(2**63) + 1]), 6)
            assert [(-int(y), int(x)) for x, y in zip(i[0], s[0], strict=True) if y != -(2**63)] == want


def test_shares():
    score = np.array([0, 1, -1, 99, 100, -100, 12345, -12345, 2**62, -(2**62)])
    assert hard_negatives._share(score, 95, up=False).tolist() == [math.floor(int(s) * 95 / 100) if abs(s) < 2**50 else int(s) * 95 // 100 for s in score]
    assert hard_negatives._share(score, 50, up=True).tolist() == [-((-int(s) * 50) // 100) for s in score]


def test_rows_of_batches():
    batch = pa.record_batch({"id": [1, 2, 3], "label": [0, 0, 1], "x": pa.array([[1, 2], [], [3]], pa.list_(pa.int64()))})
    rows = hard_negatives.Rows.of(batch.slice(1))
    assert rows.x.tolist() == [[0], [3]] and rows.ids.tolist() == [2, 3]
