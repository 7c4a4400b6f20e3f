"""Benchmark decontamination: one pass of an Aho-Corasick automaton over normalised text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held, map_arrow, stored, table, words_of

WINDOW = 13
#: Characters of windows in one automaton. Larger benchmarks are scanned for block by block.
BLOCK_CHARS = 64_000_000

def windows(words: list[bytes], width: int = WINDOW) -> list[bytes]:
    """Each run of `width` words, or all words if there are fewer; blanks around, so that only whole words match."""
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))]


def automaton(items: list[tuple[int, str]], width: int = WINDOW) -> ahocorasick.Automaton:
    """Over the windows of all items; each carries its number of words and the places of its items in the list.

    Bytes are taken as Latin-1 characters, so one byte is one character.
    """
    of: dict[bytes, set[int]] = {}
    for k, (_, text) in enumerate(items):
        for w in windows(words_of(text), width):
            of.setdefault(w, set()).add(k)
    made = ahocorasick.Automaton()
    for w, ks in of.items():
        made.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(sorted(ks))))
    made.make_automaton()
    return made


def scan(words: list[bytes], machine: ahocorasick.Automaton) -> tuple[np.ndarray, set[int]]:
    """Which words are hit, and the items with an occurring window."""
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = list(machine.iter(line)) if len(machine) else []
    hit = np.zeros(len(words) + 1, np.int64)
    items: set[int] = set()
    if found:
        ends = np.cumsum([len(w) + 1 for w in words])  # place of the blank after each word
        last = np.searchsorted(ends, [e for e, _ in found])
        n = np.array([v[0] for _, v in found])
        np.add.at(hit, last - n + 1, 1)
        np.add.at(hit, last + 1, -1)
        items.update(*(v[1] for _, v in found))
    return np.cumsum(hit[:-1]) > 0, items


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as code point offsets in the original text (end exclusive)."""
    import regex

    at = [m.span() for m in regex.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(at[a][0], at[b - 1][1]) for a, b in zip(edge[::2], edge[1::2], strict=True)]


FOUND = "hit binary, item_ids array<string>"
SCHEMA = "n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start:bigint,end:bigint>>"


def _blocks(items: Iterator[tuple[int, str]], chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in the order in which they come, in lists of at most so many characters of windows; one list at least."""
    block: list[tuple[int, str]] = []
    room = chars
    for item in items:
        need = WINDOW * len(item[1])
        if block and need > room:
            yield block
            block, room = [], chars
        block.append(item)
        room -= need
    yield block


def _scanned(docs: DataFrame, block: Broadcast, key: str, *, last: bool) -> DataFrame:
    """From row, text and what is found so far, the same with what the block's automaton finds, which is built once in each
    worker; after the last block the row and what is asked for."""

    def make():
        machine = held(f"automaton {key}", lambda: automaton(block.value))

        def run(batch) -> dict:
            out: dict = {k: [] for k in ("hit", "item_ids", "n_words", "n_hit", "spans")}
            names = [None if x[0] is None else str(x[0]) for x in block.value]
            for text, bits, known in zip(*(batch.column(c).to_pylist() for c in ("text", "bits", "known")), strict=True):
                words = words_of(text)
                hit, found = scan(words, machine)
                if bits is not None:
                    hit |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool)
                n = int(hit.sum())
                out["hit"].append(None if last else np.packbits(hit).tobytes())
                out["item_ids"].append(sorted({names[i] for i in found if names[i] is not None} | set(known or ())))
                out["n_words"].append(len(words))
                out["n_hit"].append(n)
                out["spans"].append([{"start": a, "end": b} for a, b in original_spans(text, hit)] if n and last else [])
            return out

        return run

    return map_arrow(docs, make, SCHEMA if last else FOUND, keep=["row"] if last else ["row", "text"])


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS,
    whole_rows: bool = False,
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, item_ids (as strings, sorted), spans of hit words in the original text.
    With `whole_rows`, the input's row as the struct `row` instead of the id.

    The automaton of the benchmark's 13-word windows is built once in every Python worker; documents are read once, in
    place, and nothing is shuffled. A benchmark of more than `block_chars` characters of windows is read in blocks: the
    documents are scanned for one block after the other, and what was found goes along in the shared folder. So a worker
    holds one automaton, and the driver two blocks, however large the benchmark is.

    Null or wordless text: no words, no hits. Very long texts are scanned whole. Items without words never occur; equal
    items all count. Null item ids are left out of item_ids. Repeated rows are scanned alike, a null id stays null, other
    columns are ignored; without items nothing is hit, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct().orderBy(F.col("item_id").cast("string"), "text")
    row = F.struct("*") if whole_rows else F.col(id_col)
    found = docs.select(row.alias("row"), F.col(text_col).alias("text"), F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("array<string>").alias("known"))
    blocks = _blocks((tuple(r) for r in items.toLocalIterator()), block_chars)
    block = next(blocks)
    while (after := next(blocks, None)) is not None:
        found = stored(_scanned(found, spark.sparkContext.broadcast(block), uuid.uuid4().hex, last=False))
        found = found.withColumnsRenamed({"hit": "bits", "item_ids": "known"})
        block = after
    # a block is bounded by block_chars, but for a single item that is larger
    done = _scanned(found, spark.sparkContext.broadcast(block), uuid.uuid4().hex, last=True)
    return done if whole_rows else done.withColumnRenamed("row", id_col)


#: A document is contaminated if a twentieth of its words or more are hit.
RULE = "n_hit > 0 AND 20 * n_hit >= n_words"


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        F.expr(RULE).alias("contaminated"),
    )
