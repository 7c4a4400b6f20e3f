"""Decontamination, token files, quality rules, quality scores and language ID against plain Python."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import decontaminate, language_id, quality_gam, quality_rules, token_store

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_contamination(text, items):
    words = WORD.findall((text or "").translate(ASCII))
    hit, found = set(), set()
    for i, t in items:
        own = WORD.findall((t or "").translate(ASCII))
        n = min(13, len(own))
        wins = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in wins:
                hit.update(range(k, k + n))
                found.add(str(i))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_chars", [10**9, 100])
def test_contamination(spark, docs, corpus, empty, block_chars):
    items = [(1, corpus[3][1]), (2, "Changed, BASIS"), (3, ""), (4, None), (10, " ".join(corpus[7][1].split()[:13])), (11, "É ñ"), (12, corpus[3][1]), (None, corpus[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, block_chars=block_chars).collect()
    texts = {r[0]: r[1] for r in corpus}
    named = [x for x in items if x[0] is not None]
    for r in got:
        n_words, _, found = plain_contamination(texts[r.doc_id], named)
        _, n_hit, _ = plain_contamination(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.item_ids) == (n_words, n_hit, found)
        told = [w for s in r.spans for w in WORD.findall(texts[r.doc_id][s.start : s.end].translate(ASCII))]
        assert len(told) == n_hit
    assert sum(r.n_hit > 0 for r in got) >= 3
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(empty, bench).count() == 0
    whole = decontaminate.find_contamination(docs, bench, whole_rows=True)
    assert whole.select("row.*").columns == docs.columns


def test_token_files(spark, docs, corpus, empty, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_store.tokenizer_path())
    out = str(tmp_path / "out")
    token_store.write_tokens(docs, out, token_store.tokenizer_path(), partitions=3)
    got = {r.doc_id: r for r in token_store.read_tokens(spark, out).collect()}
    short = {r.doc_id: r for r in token_store.read_tokens(spark, out, digest_only=True).collect()}
    at = 0
    for i, text, *_ in sorted(corpus, key=lambda r: r[0]):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (at, len(ids), ids.tobytes())
        assert short[i].ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)
    asked = token_store.read_tokens(spark, out, doc_ids=[403, None])
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(lo,403)" in plan and "GreaterThanOrEqual(hi,403)" in plan
    assert token_store.read_tokens(spark, out, doc_ids=[]).count() == 0
    one = asked.collect()
    assert [r.doc_id for r in one] == [403] and one[0].ids == got[403].ids
    token_store.write_tokens(empty, str(tmp_path / "none"), token_store.tokenizer_path())
    assert token_store.read_tokens(spark, str(tmp_path / "none")).count() == 0
    odd = spark.createDataFrame([(None, "b"), (5, "x"), (5, "x"), (None, None)], "doc_id long, text string")
    token_store.write_tokens(odd, str(tmp_path / "odd"), token_store.tokenizer_path())
    assert sorted((r.doc_id or -1, r.start, r.n_tokens) for r in token_store.read_tokens(spark, str(tmp_path / "odd")).collect()) == [(-1, 0, 1), (-1, 1, 2), (5, 3, 2), (5, 5, 2)]


def test_token_pieces_equal_the_library():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(token_store.tokenizer_path()), token_store.Encoder(token_store.tokenizer_path())
    for text in ["don't  I'll\n\n  x\t\ty 12a3 ²½ ª!?'s 's", " \n ", "a \u0085 b\x1c\x1d c", "'S 'LL", "a\n", "x" * 5000, "Ǆ ǅ ȧ × ÷", "  wide 東", "<|endoftext|>", "\r\n\r\n a"]:
        assert own.encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), text


def test_other_tokenizer_files_go_to_the_library(tmp_path):
    """A file with another split, normalizer or model is not cut into pieces here."""
    from tokenizers import Tokenizer

    with open(token_store.tokenizer_path(), encoding="utf-8") as f:
        said = json.load(f)
    assert token_store.Encoder(token_store.tokenizer_path()).by_pieces
    for k, change in enumerate(({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**said["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}})):
        path = str(tmp_path / f"{k}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({**said, **change}, f)
        own, tok = token_store.Encoder(path), Tokenizer.from_file(path)
        text = "Some WORDS  here, and\nOthers"
        assert not own.by_pieces and own.encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, own.dtype).tobytes()


def test_one_id_is_dealt_to_many_parts(spark, tmp_path):
    rows = [(None if k % 3 else k, f"text of number {k} " * 20) for k in range(600)]
    out = str(tmp_path / "hot")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), out, token_store.tokenizer_path(), partitions=6)
    parts = {r.part: set(r.doc_ids) for r in spark.read.parquet(f"{out}/blocks").collect()}
    assert sum(None in ids for ids in parts.values()) >= 3
    got = sorted(token_store.read_tokens(spark, out).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()] and len(got) == 600
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = defaultdict(list)
    for k in range(len(words) - 4):
        seen[tuple(words[k : k + 5])].append(k)
    marked = {k + j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_rules(spark, docs, corpus, empty):
    more = [(500, "x y z w v " * 4 + "tail"), (501, "SHOUTING!! ALL!! THE!! TIME!! HERE!! AND!! THERE!! NOW!! OR!! NEVER!! EVER!!"), (502, "a | b | c | d | e | f | g | h | i | j | k | l"), (503, "a b\x1cc " * 12)]
    texts = {r[0]: r[1] for r in corpus} | dict(more)
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = quality_rules.apply_rules(df).collect()
    other = {r.doc_id: r.kept for r in quality_rules.apply_rules(df, tuple(reversed(quality_rules.RULES))).collect()}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == other[r.doc_id]  # the order changes the cost, not the verdict
    kept = {r.doc_id: r.kept for r in got}
    assert kept[1] and not any(kept[i] for i in (500, 501, 502, 400, 401))
    assert quality_rules.apply_rules(empty).count() == 0


def test_cascade_puts_cheap_rejections_first(docs):
    import time

    slow = quality_rules.Rule("slow", lambda d: time.sleep(0.001) or True)
    never = quality_rules.Rule("never", lambda d: False)
    quick = quality_rules.Rule("quick", lambda d: True)
    gain = {n: r / s for n, r, s in quality_rules.measure(docs, (slow, never, quick))}
    assert gain["quick"] > gain["slow"] > gain["never"] == 0


def test_gam_learns_pairs():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)).astype(float)  # no feature alone tells
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    assert quality_gam.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def plain_features(text):
    text = text or ""
    data = text.encode()
    words = re.findall(rb"[^\t\n\x0b\x0c\r ]+", data)
    lines = text.split("\n")
    n, nw = max(len(data), 1), max(len(words), 1)
    among = lambda chars: sum(b in chars.encode() for b in data)
    upper, lower = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data)
    bits = -sum(c / n * np.log2(c / n) for c in Counter(data).values())
    pairs = list(zip(words, words[1:]))
    return [
        np.log(1 + len(data)), (n - sum(b in b"\t\n\x0b\x0c\r " for b in data)) / nw, max(map(len, words), default=0), upper / max(upper + lower, 1), among("0123456789") / n,
        among("!") / nw, among("#*$%&|<>") / nw, among(".") / nw, among(",") / nw, sum(b >= 128 for b in data) / n, bits, len(words) / len(lines), len(set(words)) / nw,
        len(set(pairs)) / nw, sum(a == b for a, b in pairs) / nw, 1 - len(set(lines)) / len(lines),
    ]


def plain_score(model, x):
    total = model.base
    for value, edges, table in zip(x, model.edges, model.tables):
        total += table[sum(e <= value for e in edges)]
    for i, j, table in model.pairs:
        total += table[sum(e <= x[i] for e in model.coarse[i])][sum(e <= x[j] for e in model.coarse[j])]
    return 1 / (1 + np.exp(-total))


def test_quality_query_against_plain_loops(spark, corpus, tmp_path):
    """op1 itself: features counted byte by byte, table values added one by one, labels of held-out rows without effect."""
    rows = [*corpus, (None, "no id", "en", "s"), (7, "an id again", "en", "s")]
    labels = [(r[0], int(len(r[1] or "") % 2), 0) for r in corpus[:60]] + [(7, None, 0), (None, 1, 0), (9999, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, table = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    for text in {r[1] for r in rows}:
        assert np.allclose(quality_gam.features(text), plain_features(text)), text
    model = quality_gam.train(docs, table)
    first = {}
    for i, t, *_ in rows:
        if i is not None and t is not None:
            first[i] = min(t, first.get(i, t))
    learned = sorted((i, y) for i, y, _ in labels if i is not None and y is not None and i in first and zlib.crc32(str(i).encode()) % 3 != 1)
    again = quality_gam.fit(np.array([quality_gam.features(first[i]) for i, _ in learned]), np.array([float(y) for _, y in learned]))
    assert [t.tolist() for t in again.tables] == [t.tolist() for t in model.tables] and again.base == model.base
    got = quality_gam.op1_quality(spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    scores = sorted(((r.doc_id or -1), round(r.score, 9), r.predicted) for r in got.collect())
    plain = sorted(((i or -1), round(plain_score(model, plain_features(t)), 9), int(plain_score(model, plain_features(t)) >= 0.5)) for i, t, *_ in rows)
    assert scores == plain


def test_best_cuts_by_trying_all():
    rng = np.random.default_rng(8)
    worth = lambda g, h: g.sum() ** 2 / (h.sum() + quality_gam.RIDGE)
    for _ in range(30):
        g, h = rng.normal(size=9), rng.random(9)
        best = max(range(1, 9), key=lambda m: worth(g[:m], h[:m]) + worth(g[m:], h[m:]))
        want = np.concatenate([np.full(best, g[:best].sum() / (h[:best].sum() + quality_gam.RIDGE)), np.full(9 - best, g[best:].sum() / (h[best:].sum() + quality_gam.RIDGE))])
        assert np.allclose(quality_gam._shallow_tree(g, h, 2), want) or worth(g[:best], h[:best]) + worth(g[best:], h[best:]) <= worth(g, h) + 1e-9
        g, h = rng.normal(size=(5, 4)), rng.random((5, 4))
        gain = lambda i, j: sum(worth(g[a, b], h[a, b]) for a in (slice(0, i), slice(i, 5)) for b in (slice(0, j), slice(j, 4))) - worth(g, h)
        assert np.isclose(quality_gam._quadrants(g, h)[0], max(gain(i, j) for i in range(1, 5) for j in range(1, 4)))


def test_queries_of_rows_against_plain(spark, corpus, tmp_path):
    """op2, op3 and op9 as they are registered: digests, nulls, column names and types."""
    from tokenizers import Tokenizer

    rows = [*corpus, (None, "the grain of the field", "en", None)]
    items = [(10, corpus[3][1]), (9, corpus[3][1]), (None, corpus[4][1]), (11, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {r[0]: r[1] for r in rows}
    got = decontaminate.op2_decontaminate(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, _, named = plain_contamination(texts[r.doc_id], [x for x in items if x[0] is not None])
        _, hit, _ = plain_contamination(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), hit > 0 and 20 * hit >= n)
    tok = Tokenizer.from_file(token_store.tokenizer_path())
    tokens = token_store.op3_token_store(spark, str(tmp_path))
    assert tokens.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and {t for _, t in tokens.dtypes} == {"bigint"}
    at = 0
    for r, (i, text, *_) in zip(sorted(tokens.collect(), key=lambda r: r.start), sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), strict=True):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    found = {r.doc_id: r for r in language_id.op9_language_id(spark, str(tmp_path)).collect()}
    assert set(found) == set(texts)
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", texts[i] or "")) and r.lang_pred in ("und", "en", "de")


def test_quality_scores(spark, docs, corpus, empty):
    labels = spark.createDataFrame([(r[0], int(r[0] % 2), 0) for r in corpus[:60]] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_gam.train(docs, labels)
    got = quality_gam.score_quality(docs, model).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    # held-out labels don't change the model
    flipped = [(r[0], int(r[0] % 2) ^ (zlib.crc32(str(r[0]).encode()) % 3 == 1), 0) for r in corpus[:60]]
    again = quality_gam.train(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert [t.tolist() for t in again.tables] == [t.tolist() for t in model.tables]
    assert quality_gam.score_quality(empty, model).count() == 0
    nothing = quality_gam.train(empty, labels)
    assert quality_gam.score_quality(docs, nothing).where("score <> 0.5").count() == 0


def test_ppm_is_a_distribution():
    rows = []
    for text, lang in (("the thing with the other thing", "en"), ("das ding mit dem anderen ding", "de")):
        g, n = np.unique(language_id.grams(text * 3), return_counts=True)
        rows += [(lang, int(a), int(b)) for a, b in zip(g, n, strict=True)]
    model = language_id.Ppm(language_id.counts_of(rows))
    used = sorted({b for _, g, _ in rows for b in g.to_bytes(4, "big")})
    symbols = [*used, next(b for b in range(256) if b not in used)]  # all bytes that were never seen are one symbol
    contexts = {g >> 8 for _, g, _ in rows} | {0, 0x7A7A7A, 0x207468}
    grams = np.array([[c << 8 | b for b in symbols] for c in sorted(contexts)], np.uint32)
    p = np.exp2(-model.bits(grams.ravel()).astype(float)).reshape(*grams.shape, 2).sum(1)
    assert np.allclose(p, 1, atol=1e-5)


def plain_ppm(rows, langs, text):
    """Code length by walking contexts of 3, 2, 1 and 0 bytes, with escapes (method C), byte by byte."""
    counts = [defaultdict(Counter) for _ in range(4)]
    used = {b for _, g, _ in rows for b in g.to_bytes(4, "big")}
    size = len(used) + 1
    for lang, g, n in rows:
        q = g.to_bytes(4, "big")
        for k in range(4):
            counts[k][lang, q[3 - k : 3]][q[3]] += n
    symbols = [*sorted(used), None]

    def dist(lang, context, k):
        if k < 0:
            return dict.fromkeys(symbols, 1 / 256)
        low = dist(lang, context[1:] if k else b"", k - 1)
        seen = counts[k][lang, context]
        total = sum(seen.values())
        if not total or (k == 3 and total < language_id.LEAST_SEEN):
            return low
        d = len(seen)
        left = sum(p for s, p in low.items() if s not in seen)
        return {s: seen[s] / (total + d) if s in seen else d / (total + d) * p / left for s, p in low.items()}

    b = bytes(2) + language_id.coded(text).tobytes()
    out = []
    for lang in langs:
        bits = 0.0
        for i in range(3, len(b)):
            bits -= np.log2(dist(lang, b[i - 3 : i], 3)[b[i] if b[i] in used else None])
        out.append(bits)
    return out


def test_ppm_code_lengths(monkeypatch):
    rows = []
    for text, lang in (("the thing with the other thing. the end of the thing", "en"), ("das ding mit dem anderen ding. das ende vom ding", "de")):
        g, n = np.unique(language_id.grams(text), return_counts=True)
        rows += [(lang, int(a), int(c)) for a, c in zip(g, n, strict=True)]
    model = language_id.Ppm(language_id.counts_of(rows))
    texts = ["the thing", "dem ding", "Zebra 99 the É", "x", "the thing " * 30]
    plain = np.array([plain_ppm(rows, model.langs, text) for text in texts])
    assert np.allclose(model.code_lengths(texts), plain, rtol=1e-5)
    monkeypatch.setattr(language_id, "PIECE", 7)
    monkeypatch.setattr(language_id, "TOGETHER", 1)
    assert np.allclose(language_id.Ppm(language_id.counts_of(rows)).code_lengths(texts), plain, rtol=1e-5)


def test_many_languages_take_room_by_what_they_hold():
    rng = np.random.default_rng(2)
    rows = [(f"l{k:03}", int(g), int(n)) for k in range(120) for g, n in zip(np.unique(rng.integers(0, 1 << 32, 300)), rng.integers(1, 9, 300), strict=False)]
    model = language_id.Ppm(language_id.counts_of(rows))
    held = sum(x.nbytes for t in model.trees for x in (t.one, t.keys3, t.seen3, t.nodes2, t.escape2, t.keys4, t.seen4, t.nodes3, t.escape3))
    assert held < 100_000_000 and model.code_lengths(["some text"]).shape == (1, 120)


def test_languages(spark, empty):
    rng = np.random.default_rng(1)
    vocab = {"en": ["the", "thing", "with", "other", "and", "house"], "fr": ["le", "été", "avec", "autre", "où", "maison"], "de": ["das", "über", "mit", "andere", "und", "haus"]}
    rows = [(i, " ".join(rng.choice(vocab[lang], 30)), lang) for i, lang in enumerate(["en", "fr", "de"] * 40)]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "123 ... !!", "de"), (903, "the house " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df)
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    held = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] < 900]
    assert held and all(got[i].lang_pred == lang for i, _, lang in held)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "en"
    # held-out rows teach nothing
    other = spark.createDataFrame([(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows], df.schema)
    assert language_id.learn(other) == model
    assert language_id.learn(empty).num_rows == 0 and language_id.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(df, language_id.counts_of([])).collect()} == {"und"}
    assert language_id.predict(df, model, whole_rows=True).select("row.*").columns == df.columns
