"""Token-id output: documents as separately compressed id arrays with a shared zstandard dictionary and an offset index.

File format, written by Spark so that task retries leave whole files, below one folder:

    dictionary   one row: dict_sha256, dict (bytes of the trained dictionary; empty if there was too little to train on),
                 width (bytes per id)
    blocks       rows of about BLOCK_BYTES, dealt by ranges of doc_id: part, block, dict_sha256, lo and hi (the least and
                 largest id in it), start (ids before the block within its part), doc_ids, n_tokens, offsets (of each document's frame in payload, and the end),
                 payload (frames, each a document's little-endian ids)
    parts        part, base (ids in all parts before it)

A document is read alone: its block by lo and hi, which Parquet keeps statistics of, its frame by the offsets, decompressed
with the dictionary.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
import zlib
from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held, map_arrow, shared_dir, small_batches, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
DICT_BYTES = 64 * 1024
#: Documents whose ids train the dictionary, in the mean, and how many ids of each: bounds what comes to the driver.
DICT_DOCS, DICT_IDS = 2000, 4096
BLOCK_BYTES = 1 << 20
#: Pieces of text whose ids a worker remembers.
CACHE_PIECES = 800_000

_LETTER, _NUMBER, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
#: How byte-level models split a text into pieces, for characters below U+0250. Texts with others go to the library whole.
PIECES = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
BEYOND = re.compile("[^\x00-ɏ]")


def _byte_chars() -> dict[int, str]:
    """The characters by which byte-level models write bytes: printable ones for themselves, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


BYTE_CHARS = _byte_chars()


class Pieces(dict):
    """Little-endian ids by piece of text; a piece that is met for the first time is encoded."""

    def __init__(self, model, code: str):
        self.tokenize, self.code = model.tokenize, code

    def __missing__(self, piece: str) -> bytes:
        """A piece is what the pre-tokenizer would give, so it goes to the library's model alone."""
        ids = array(self.code, [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARS))])
        if sys.byteorder == "big":
            ids.byteswap()
        self[piece] = found = ids.tobytes()
        return found


#: What PIECES stands for, as a tokenizer's file says it: only for such files are pieces cut here.
SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}


class Encoder:
    """Ids of texts by the tokenizers library. If the file's normalizer, pre-tokenizer and model are those that PIECES is
    written for, ids of recurring pieces are remembered; else each text goes to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Pieces(self.tokenizer.model, "H" if self.dtype.itemsize == 2 else "I")
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        self.by_pieces = (
            all(said.get(k) is None for k in ("normalizer", "truncation", "padding"))
            and all(split.get(k) == v for k, v in SPLIT.items())
            and all(model.get(k) == v for k, v in PLAIN.items())
            and not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in said.get("added_tokens", []))
        )

    def encode(self, text: str) -> bytes:
        """Little-endian ids of a text."""
        if not self.by_pieces or BEYOND.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, PIECES.findall(text)))


def encoder(path: str) -> Encoder:
    return held(f"encoder {path}", lambda: Encoder(path))


def train_dictionary(docs: DataFrame, path: str, *, id_col: str, text_col: str) -> bytes:
    """From a sample of all rows, drawn by a hash of the id: DICT_DOCS documents in the mean, encoded whole where they are.
    Of each, a stretch of DICT_IDS ids at most comes to the driver, from a place that depends on the text."""
    rows = docs.count()
    if not rows:
        return b""
    drawn = docs.where(F.pmod(F.xxhash64(id_col, F.lit("dictionary")), F.lit(1_000_000)) < -(-DICT_DOCS * 1_000_000 // rows)).select(F.col(text_col).alias("t"))

    def make():
        coder = encoder(path)
        width = coder.dtype.itemsize

        def run(batch) -> dict:
            found = []
            for text in batch.column("t").to_pylist():
                data = coder.encode(text)
                more = len(data) // width - DICT_IDS
                at = width * (zlib.crc32(data) % (more + 1)) if more > 0 else 0
                found.append(data[at : at + DICT_IDS * width])
            return {"ids": found}

        return run

    # equal ids, as null ones are, are drawn together: no more than so many of them either
    samples = sorted(r.ids for r in map_arrow(drawn, make, "ids binary").where("length(ids) > 0").limit(2 * DICT_DOCS).collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b""


BLOCK_SCHEMA = (
    "part int, block int, dict_sha256 string, lo bigint, hi bigint, start bigint, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, payload binary"
)


def write_tokens(
    docs: DataFrame, out: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, partitions: int | None = None
) -> None:
    """Encode each text, append `end_id`, and write the ids in ascending order of id below `out` (see the module).

    One shuffle: texts are dealt by ranges of the id, rows of one id by a hash of the text, and rows that are equal in both by
    a number, so that an id or a row that is very often there is no hot spot; they are sorted within each range. A worker holds one block and one Arrow batch at a time. Only
    the parts' totals come to the driver: a row per partition.

    Null text counts as empty (the end id alone); very long ones are encoded whole. Null ids come first. Rows with one id
    are all written, in an order that depends on their texts alone; other columns are ignored. Empty input writes empty files.
    """
    spark = docs.sparkSession
    words = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trained = train_dictionary(words, tokenizer_path, id_col="id", text_col="text")
    digest = hashlib.sha256(trained).hexdigest()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = words.withColumns({"h": F.xxhash64("text"), "nth": F.monotonically_increasing_id()}).repartitionByRange(n, "id", "h", "nth")
    ordered = dealt.sortWithinPartitions("id", "h", "text").drop("h", "nth")

    def run(batches):
        coder = encoder(tokenizer_path)
        end = np.array([] if end_id is None else [end_id], coder.dtype).tobytes()
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdCompressor(level=3)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        room = BLOCK_BYTES

        def flush():
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).tolist()
            known = [i for i in ids if i is not None]
            row = [part], [block], [digest], [min(known, default=None)], [max(known, default=None)], [start], [ids], [counts], [offsets], [b"".join(frames)]
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)

        gc.disable()  # else it walks the growing table of pieces again and again; nothing here refers to itself
        for batch in batches:
            names, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for name, text in zip(names, texts, strict=True):
                data = coder.encode(text) + end
                frame = packer.compress(data)
                if frames and len(frame) > room:
                    yield flush()
                    block, start, room = block + 1, start + sum(counts), BLOCK_BYTES
                    ids, counts, frames = [], [], []
                ids.append(name)
                counts.append(len(data) // coder.dtype.itemsize)
                frames.append(frame)
                room -= len(frame)
        gc.enable()
        if frames:
            yield flush()

    small_batches(ordered).mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{out}/blocks")
    width = encoder(tokenizer_path).dtype.itemsize
    spark.createDataFrame([(digest, trained, width)], "dict_sha256 string, dict binary, width int").coalesce(1).write.parquet(f"{out}/dictionary")
    totals = (
        spark.read.parquet(f"{out}/blocks")
        .groupBy("part")
        .agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
        .orderBy("part")
        .collect()
    )
    bases, at = [], 0
    for r in totals:
        bases.append((r.part, at))
        at += r.n
    spark.createDataFrame(bases, "part int, base bigint").coalesce(1).write.parquet(f"{out}/parts")


ROW_SCHEMA = "part int, id bigint, local bigint, n_tokens bigint, ids binary"


def _unpacked(spark: SparkSession, blocks: DataFrame, out: str, made, schema: str) -> DataFrame:
    d = spark.read.parquet(f"{out}/dictionary").first()
    trained, digest, width = bytes(d.dict), d.dict_sha256, d.width

    def make():
        known = zstandard.ZstdCompressionDict(trained) if trained else None
        unpack = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()

        def run(batch):
            rows: list[tuple] = []
            for b in batch.to_pylist():
                if b["dict_sha256"] != digest:
                    raise ValueError(f"block {b['part']}/{b['block']} needs dictionary {b['dict_sha256']}")
                at = b["start"]
                for k, (name, n) in enumerate(zip(b["doc_ids"], b["n_tokens"], strict=True)):
                    data = unpack.decompress(b["payload"][b["offsets"][k] : b["offsets"][k + 1]])
                    rows.append((b["part"], name, at, n, made(np.frombuffer(data, f"<u{width}"))))
                    at += n
            part, ids, local, n, value = zip(*rows, strict=True)
            return {"part": part, "id": ids, "local": local, "n_tokens": n, schema.rpartition(", ")[2].split()[0]: value}

        return run

    return map_arrow(blocks, make, schema)


#: Ranges that a lookup of many documents is put into.
RANGES = 64


def _may_hold(ids: list[int]) -> Column:
    """Whether a block's range meets that of some of the ids, as comparisons that Parquet can be asked."""
    size = max(1, -(-len(ids) // RANGES))
    parts = [ids[k : k + size] for k in range(0, len(ids), size)]
    return reduce(lambda a, b: a | b, ((F.col("lo") <= p[-1]) & (F.col("hi") >= p[0]) for p in parts), F.lit(False))


def read_tokens(spark: SparkSession, out: str, *, digest_only: bool = False, doc_ids: list[int] | None = None) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, and ids (little-endian u32) or, with digest_only, ids_crc32.

    `doc_ids` reads these documents only: of blocks that can't hold one, Parquet's statistics of lo and hi tell that their
    payload need not be read. A null in it finds nothing; null ids are read with the rest. Empty files give no rows.
    """
    blocks = spark.read.parquet(f"{out}/blocks")
    if doc_ids is not None:
        blocks = blocks.where(_may_hold(sorted({i for i in doc_ids if i is not None})))
    if digest_only:
        rows = _unpacked(spark, blocks, out, lambda a: zlib.crc32(a.astype("<u4").tobytes()), ROW_SCHEMA.replace("ids binary", "ids_crc32 bigint"))
    else:
        rows = _unpacked(spark, blocks, out, lambda a: a.astype("<u4").tobytes(), ROW_SCHEMA)
    if doc_ids is not None:
        rows = rows.where(F.col("id").isin(doc_ids))
    parts = F.broadcast(spark.read.parquet(f"{out}/parts"))  # a row per partition of the writer
    last = "ids_crc32" if digest_only else "ids"
    return rows.join(parts, "part").select(F.col("id").alias("doc_id"), (F.col("base") + F.col("local")).alias("start"), "n_tokens", last)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_path())
    return read_tokens(spark, out, digest_only=True)
