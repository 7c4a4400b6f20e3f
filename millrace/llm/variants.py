"""Spelling variants of words: forms that differ by one inserted, deleted or replaced code point, without pairs of words.

A word stands in one group for each of its places, (place, prefix, suffix), written prefix * suffix: members of such a
group differ by a replacement. It also stands under each distinct string that it becomes by a deletion, next to the word
that is spelled so, if there is one: these differ by an insertion or a deletion. Of a group only its size and its two
best words are kept; each member takes the best that it isn't itself. Two words meet in one group at most, so sizes add
up. A group holds a word for each letter (and, under a deletion, for each place) at most, however large the corpus is.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, stored, table

LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
#: One in so many runs of the op11 query loses a letter.
SPOIL = 31
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 1 << 18
#: Latin-1 bytes: A-Z become a-z, what is no letter a blank; bytes from 0xC0 on stay.
RUN_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs [A-Za-zÀ-ÿ]+ of a text, A-Z lower-cased, as Latin-1: a byte is a code point."""
    return text.encode("latin-1", "replace").translate(RUN_TABLE).split() if text else []


def spoiled(run: bytes, head: int, one_in: int) -> bytes:
    """The run without one code point, if its checksum, begun with that of the id, says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, spoil: int | None = None
) -> DataFrame:
    """(word, n) of all words of at least that length, in code points, and that many occurrences in all texts.

    A task counts its words and hands on sums, so a frequent word is no hot key. With `spoil`, a run whose crc32 of
    "<id>:<run>" is divisible by it loses a letter first. Null and empty texts have no words; a null id is an empty one
    there; rows of one id, and repeated rows, all count. An empty table has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                head = zlib.crc32(b"%s:" % (doc or "").encode())
                for word, n in Counter(r for r in runs_of(text.as_py()) if len(r) >= least_length).items():
                    if spoil:
                        word = spoiled(word, head, spoil)
                        if len(word) < least_length:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD_WORDS:
                    yield told()
                    counts.clear()
        if counts:
            yield told()

    texts = small_batches(docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).where("text != ''"))
    counted = texts.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def groups(words: DataFrame, least_length: int) -> DataFrame:
    """(key, word, n): the groups that each word of words(word, n) stands in."""
    at = F.sequence(F.lit(1), F.length("word"))
    left, right = lambda i: F.substring(F.col("word"), F.lit(1), i - 1), lambda i: F.substring(F.col("word"), i + 1, F.length("word"))
    replaced = F.transform(at, lambda i: F.concat(left(i), F.lit("*"), right(i)))
    # a string under the least length is no word; so are the deletions of words just above it
    shorter = F.when(F.length("word") > least_length, F.array_distinct(F.transform(at, lambda i: F.concat(left(i), right(i)))))
    keys = F.concat(replaced, F.coalesce(shorter, F.array().cast("array<string>")), F.array("word"))
    return words.select(F.explode(keys).alias("key"), "word", "n")


def near_words(words: DataFrame, least_length: int) -> DataFrame:
    """From words(word, n), distinct: (word, n, n_near, best): how many others are near, and (-n, word) of the best."""
    # the word that a deletion spells comes first under it, all others by number
    order = Window.partitionBy("key").orderBy(F.desc(F.col("word") == F.col("key")), F.desc("n"), "word")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    this = F.struct((-F.col("n")).alias("m"), F.col("word").alias("w"))
    seen = groups(words, least_length).select(
        "key", "word", "n", F.count("*").over(whole).alias("size"), F.first(this).over(whole).alias("first"), F.nth_value(this, 2).over(whole).alias("second")
    )
    wild, leads = F.contains("key", F.lit("*")), F.col("word") == F.col("first.w")
    met = seen.where((F.col("size") > 1) & (wild | (F.col("first.w") == F.col("key"))))
    near = met.select("word", "n", F.when(wild | leads, F.col("size") - 1).otherwise(1).alias("near"), F.when(leads, F.col("second")).otherwise(F.col("first")).alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<m: bigint, w: string>").alias("best"))
    return near.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """From forms(word, form), without nulls: (word, root), the last of each chain of forms.

    Each round doubles the steps that were followed. Counts grow tenfold from a word to its form, so chains are short and
    have no circles.
    """
    found = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        seen = Observation()
        after = found.select(F.col("word").alias("root"), F.col("root").alias("after"))
        moved = found.join(after, "root", "left").observe(seen, F.count("after").alias("moved"))
        found = stored(moved.select("word", F.coalesce("after", "root").alias("root")))
        if not seen.get.get("moved"):
            return found


def spelling_variants(words: DataFrame, *, least_length: int = LEAST_LENGTH, factor: int = FACTOR) -> DataFrame:
    """From words(word, n): word, form, root, n, n_near, form_n. A word's form is its near word of largest n (ties: the
    smallest in code-point order), if that is at least `factor` times the word's own; root is the last form of forms.

    Words are distinct strings of letters of at least `least_length`; with none there are no rows. Rows of one word with
    different n count as the largest. Whatever else is in `words` is left out.
    """
    known = stored(words.where("word IS NOT NULL").groupBy("word").agg(F.max("n").alias("n")))
    best = near_words(known, least_length)
    formed = -F.col("best.m") >= factor * F.col("n")
    found = stored(best.select("word", "n", "n_near", F.when(formed, F.col("best.w")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")))
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), spoil=SPOIL))
