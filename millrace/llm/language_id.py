"""Language ID: prediction by partial matching over bytes, one frozen context tree per language."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held, id_remainder, map_arrow, table

#: Documents of a language to learn from, in the mean: ids are drawn by a hash against this share of the language's rows.
TRAIN_DOCS = 1500
#: A context of three bytes is a node of a language's tree from this many times on.
LEAST_SEEN = 3
#: Strings that are looked up at once, and languages that share a table.
PIECE, TOGETHER = 1 << 18, 8
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}")
_DIGITS = {c: "0" for c in range(0x31, 0x3A)}


def coded(text: str) -> np.ndarray:
    """The lower-cased UTF-8 bytes, digits as 0, after a line feed that stands for what comes before the text."""
    return np.frombuffer(b"\n" + text.lower().translate(_DIGITS).encode(), np.uint8)


def gram_pieces(text: str) -> Iterator[np.ndarray]:
    """Each byte with the three before it, as one number, some at a time; bytes before the start of the text are 0."""
    b = np.concatenate((np.zeros(2, np.uint8), coded(text)))
    for at in range(0, len(b) - 3, PIECE):
        x = b[at : at + PIECE + 3].astype(np.uint32)
        yield x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


def grams(text: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *gram_pieces(text)])


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    """Rows of values for the wanted keys; keys are sorted."""
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), default, np.float32)
    at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
    out = values[at]
    out[keys[at] != wanted] = default
    return out


class _Trees:
    """Context trees of some languages. What a tree lacks takes no room; languages that are scored together share keys."""

    def __init__(self, n_langs: int, used: np.ndarray, lang: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.code = np.zeros(256, np.int64)  # 0: all bytes that no language has
        self.code[used] = np.arange(1, len(used) + 1)
        self.size = a = len(used) + 1
        self.langs = n_langs
        uniform = np.full((n_langs, 1, a), 1 / 256)
        first, byte = self.code[gram >> 8 & 0xFF], self.code[gram & 0xFF]
        p0 = self._dense(uniform, np.zeros(1, np.int64), lang, np.zeros(len(lang), np.int64), byte, count, 1)
        p1 = self._dense(p0, np.zeros(a, np.int64), lang, first, byte, count, a)
        self.one = np.ascontiguousarray(-np.log2(np.maximum(p1, 1e-12)).transpose(1, 2, 0).reshape(-1, n_langs).astype(np.float32))
        lang3, three, n3 = self._summed(lang, gram & 0xFFFFFF, count)
        low = p1[lang3, self.code[three >> 8 & 0xFF], self.code[three & 0xFF]]
        self.keys3, self.seen3, self.nodes2, self.escape2, p2 = self._order(lang3, three, n3, low, 1)
        place = np.searchsorted(lang3 << 24 | three, lang << 24 | gram & 0xFFFFFF)  # in order of language and string
        self.keys4, self.seen4, self.nodes3, self.escape3, _ = self._order(lang, gram, count, p2[place], LEAST_SEEN)

    @staticmethod
    def _dense(lower, parent, lang, context, byte, count, n):
        """Probabilities [language, context, byte] of an order from those of the lower one."""
        n_langs, _, a = lower.shape
        c = np.bincount((lang * n + context) * a + byte, count, n_langs * n * a).reshape(n_langs, n, a)
        total, distinct = c.sum(2, keepdims=True), (c > 0).sum(2, keepdims=True)
        below = lower[:, parent, :]
        unseen = np.where(c > 0, 0.0, below)
        left = unseen.sum(2, keepdims=True)
        escape = np.divide(distinct, total + distinct, out=np.zeros_like(total), where=total > 0)
        share = np.divide(unseen, left, out=np.zeros_like(unseen), where=left > 0)
        own = np.divide(c, total + distinct, out=np.zeros_like(c), where=total > 0)
        return np.where(total > 0, own + escape * share, below)

    @staticmethod
    def _summed(lang, key, count):
        both, place = np.unique(lang << 24 | key, return_inverse=True)
        return both >> 24, both & 0xFFFFFF, np.bincount(place, count, len(both))

    def _order(self, lang, key, count, low, least):
        """A higher order, from each string's count and what the lower order gives it: strings, code lengths by language
        (NaN where not seen), contexts, what an escape from them adds, and the probabilities of the strings."""
        context, place = np.unique(lang << 24 | key >> 8, return_inverse=True)
        total, distinct = np.bincount(place, count, len(context)), np.bincount(place, minlength=len(context))
        left = np.maximum(1 - np.bincount(place, low, len(context)), 1e-12)
        p = count / (total + distinct)[place]
        keep = total >= least
        escape = -np.log2(distinct / (total + distinct) / left)
        seen, nodes = keep[place], np.flatnonzero(keep)
        keys, at = np.unique(key[seen], return_inverse=True)
        bits = np.full((len(keys), self.langs), np.nan, np.float32)
        bits[at, lang[seen]] = -np.log2(p[seen])
        known, at = np.unique(context[nodes] & 0xFFFFFF, return_inverse=True)
        more = np.zeros((len(known), self.langs), np.float32)
        more[at, context[nodes] >> 24] = escape[nodes]
        return keys, bits, known, more, p

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code lengths [gram, language]; fastest if grams are sorted."""
        g = gram.astype(np.int64)
        out = self.one[self.code[g >> 8 & 0xFF] * self.size + self.code[g & 0xFF]]
        for keys, seen, nodes, escape, of in ((self.keys3, self.seen3, self.nodes2, self.escape2, g & 0xFFFFFF), (self.keys4, self.seen4, self.nodes3, self.escape3, g)):
            own = _found(keys, seen, of, np.nan)
            out = np.where(np.isnan(own), out + _found(nodes, escape, of >> 8, 0.0), own)
        return out


COUNTS = pa.schema({"lang": pa.string(), "gram": pa.int64(), "n": pa.int64()}.items())


def counts_of(rows: list[tuple[str, int, int]]) -> pa.Table:
    """Counts as learn() gives them, from language, string and count."""
    return pa.table(dict(zip(COUNTS.names, zip(*rows), strict=True)) if rows else {n: [] for n in COUNTS.names}, schema=COUNTS)


class Ppm:
    """Code lengths of a byte after its three predecessors, for all languages at once.

    Order -1 gives each byte 1/256. Order k gives a byte seen n times in a context c(n)/(total + distinct) and escapes
    with distinct/(total + distinct) (method C); an escape shares what lower orders give to the bytes not seen in the
    context, so every context's probabilities add up to one. A context that a language's tree lacks falls back to the
    next lower order without a charge. Counts don't change while scoring, so a code length depends on four bytes alone.
    Only strings that were seen, and their contexts, are held: memory follows what was learned, not languages times 256^3.
    """

    def __init__(self, counts: pa.Table):
        """counts: as learn() gives them."""
        self.langs = sorted(set(counts.column("lang").to_pylist()))
        lang = pc.index_in(counts.column("lang"), pa.array(self.langs, pa.string())).to_numpy().astype(np.int64)
        gram = counts.column("gram").to_numpy().astype(np.int64)
        count = counts.column("n").to_numpy().astype(np.float64)
        by = np.lexsort((gram, lang))
        lang, gram, count = lang[by], gram[by], count[by]
        used = np.unique(np.concatenate([gram >> s & 0xFF for s in (24, 16, 8, 0)]))
        self.trees = []
        for a in range(0, len(self.langs), TOGETHER):
            here = (lang >= a) & (lang < a + TOGETHER)
            self.trees.append(_Trees(min(TOGETHER, len(self.langs) - a), used, lang[here] - a, gram[here], count[here]))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code lengths [gram, language]."""
        return np.hstack([t.bits(gram) for t in self.trees])

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of whole texts [text, language]. Strings of several texts are looked up at once, and long texts in pieces,
        so memory doesn't follow their length."""
        total = np.zeros((len(texts), len(self.langs)))
        waiting: list[np.ndarray] = []
        of: list[int] = []
        size = 0

        def add() -> None:
            gram, place = np.unique(np.concatenate(waiting), return_inverse=True)
            starts = np.cumsum([0, *map(len, waiting[:-1])])
            np.add.at(total, of, np.add.reduceat(self.bits(gram)[place], starts, axis=0, dtype=np.float64))
            waiting.clear()
            of.clear()

        for k, text in enumerate(texts):
            for piece in gram_pieces(text):
                waiting.append(piece)
                of.append(k)
                size += len(piece)
                if size >= PIECE:
                    add()
                    size = 0
        if waiting:
            add()
        return total


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> pa.Table:
    """lang, gram (four bytes as one number) and n, how often it was seen, from rows whose id's remainder by 5 is not 0.

    A sample bounded in the mean by `train_docs` documents for each language, drawn by a hash of the id, whatever the
    language's share; whole texts. What comes to the driver are the distinct four-byte strings of that sample.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(F.col("id"), 5) != 0)
    )
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return counts_of([])
    share = F.lit(0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1_000_000, train_docs * 1_000_000 // n + 1))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1_000_000)) < share)

    def make():
        def run(batch) -> dict:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            out: dict = {"lang": [], "gram": [], "n": []}
            for lang, parts in by.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                out["lang"] += [lang] * len(g)
                out["gram"] += g.tolist()
                out["n"] += n.tolist()
            return out

        return run

    counted = map_arrow(drawn.select("lang", "text"), make, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return counted.toArrow().cast(COUNTS).sort_by([("lang", "ascending"), ("gram", "ascending")])


def predict(
    docs: DataFrame, counts: pa.Table, *, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False
) -> DataFrame:
    """One row per input row: id, lang_pred, score, bits (per byte, in the predicted language). With `whole_rows`, the
    input's row as the struct `row` instead of the id.

    The language with the shortest code length of the whole text; score: its share of probability against the others.
    Texts are scored in place, without a shuffle. Null text, text without a letter, and any text when nothing was
    learned: `und`, score 0. Ties go to the first language by name. A null id stays null; repeated rows get equal rows;
    other columns, the known language among them, are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(counts)  # learned from a bounded sample
    key = f"ppm {uuid.uuid4().hex}"

    def make():
        model = held(key, lambda: Ppm(known.value)) if known.value.num_rows else None

        def run(batch) -> dict:
            texts = batch.column("text").to_pylist()
            read = [k for k, t in enumerate(texts) if t and model is not None and _letter.search(t)]
            out: dict = {"id": batch.column("id").to_pylist(), "lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "bits": [0.0] * len(texts)}
            if read:
                totals = model.code_lengths([texts[k] for k in read])
                best = totals.argmin(1)
                for k, total, j in zip(read, totals, best.tolist(), strict=True):
                    out["lang_pred"][k] = model.langs[j]
                    out["bits"][k] = float(total[j]) / max(len(texts[k].encode()), 1)
                    out["score"][k] = float(1 / np.exp2(np.maximum(total[j] - total, -1000)).sum())
            return out

        return run

    schema = "id bigint, lang_pred string, score double, bits double"
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    if whole_rows:
        return map_arrow(docs.select(*columns, F.struct("*").alias("row")), make, schema, keep=["row"]).drop("id")
    return map_arrow(docs.select(*columns), make, schema).withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select(
        "doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score"
    )
