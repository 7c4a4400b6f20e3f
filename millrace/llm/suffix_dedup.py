"""Suffix-array dedup: bytes that repeat an earlier string of 100 bytes are removed, over all documents.

An external induced sort carries a tuple and a common-prefix value for every suffix through queues on disk: some 6 bytes
for each byte of text and level, which is beyond the disk that this step may use (see the README for figures). What is
kept of it is the induction: only sampled positions are sorted, by Spark's external sort, and all others follow.

1. Each string of 100 bytes has an anchor, chosen by its content alone. Neighbouring strings share anchors: one tuple
   (hash of the anchor's gram, hash of all bytes that its strings cover, place) stands for some 35 suffixes.
2. The tuples are sorted by both hashes and place. Where all covered bytes are equal to an earlier tuple's, all its
   strings are repeats. Where a gram has one tuple only, none is.
3. What is left are the first tuples of grams with several coverings: the ends of repeats. Their covered bytes meet by
   gram, their strings are compared one by one, and the earliest of equal strings stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from millrace.llm.common import NO_ID, small_batches, stored, table
from millrace.llm.repeats import SEGMENT, WIDTH, Hashed, anchors, covered, mixed

#: Bytes of text that travel together.
CHUNK_BYTES = 1 << 20
#: Coverings of one gram up to which they meet in one task; beyond, their strings are dealt one by one.
MEETING = 50_000
#: Coverings of one gram that a task deals by the gram; further ones are dealt by themselves.
BY_GRAM = 16
#: Slots of the tables in which a task remembers tuples and grams, and strings that are compared at once.
SLOTS, STRINGS = 1 << 18, 1 << 20

_LONG, _INT = pa.int64(), pa.int32()
CHUNK = pa.schema({"chunk": _LONG, "ids": pa.list_(_LONG), "ends": pa.list_(_LONG), "packed": pa.binary()}.items())
TUPLE = pa.schema({"gram": _LONG, "cover": _LONG, "doc": _LONG, "chunk": _LONG, "pos": _INT, "n": _INT, "kind": pa.int8()}.items())
PLAIN, SETTLED, CROWDED = 0, 1, 2
ENDS = pa.schema(
    {"gram": _LONG, "doc": _LONG, "chunk": _LONG, "pos": _INT, "n": _INT, "data": pa.binary(), "string1": _LONG, "string2": _LONG}.items()
)
RUN = pa.schema({"chunk": _LONG, "pos": _INT, "n": _INT}.items())
_SPANS = pa.list_(pa.struct({"start": _LONG, "end": _LONG}.items()))
RESULT = pa.schema({"id": _LONG, "n_bytes": _LONG, "n_removed": _LONG, "spans": _SPANS, "kept": pa.binary()}.items())
DIGEST = pa.schema({"id": _LONG, "n_bytes": _LONG, "n_removed": _LONG, "n_spans": _LONG, "kept_sha256": pa.string()}.items())


def _mapped(df: DataFrame, run, schema: pa.Schema) -> DataFrame:
    return small_batches(df).mapInArrow(run, from_arrow_schema(schema))


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, columns, strict=True)], schema=schema)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents packed into chunks; a document is never cut."""
    part, seq, packer = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=3)
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in texts])
        return _batch(CHUNK, [[part + seq], [ids], [ends], [packer.compress(b"".join(texts))]])

    for batch in batches:
        for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = (text or "").encode()
            if ids and size + len(data) > CHUNK_BYTES:
                yield flush()
                ids, texts, size, seq = [], [], 0, seq + 1
            ids.append(name)
            texts.append(data)
            size += len(data)
    if ids:
        yield flush()


class _Chunk:
    def __init__(self, batch: pa.RecordBatch, k: int):
        self.chunk = batch.column("chunk")[k].as_py()
        self.ids = batch.column("ids")[k].as_py()
        self.ends = np.array(batch.column("ends")[k].as_py(), np.int64)
        self.data = np.frombuffer(zstandard.decompress(batch.column("packed")[k].as_py()), np.uint8)
        self.order = np.array([NO_ID if x is None else x for x in self.ids], np.int64)


def _runs(batch: pa.RecordBatch, name: str, k: int, field: str) -> np.ndarray:
    values = batch.column(name)[k].values
    return np.zeros(0, np.int64) if values is None else values.field(field).to_numpy(zero_copy_only=False).astype(np.int64)


class _Seen:
    """What a task remembers of its tuples, in tables of fixed size: a slot holds what came last."""

    def __init__(self, slots: int = SLOTS, by_gram: int = BY_GRAM):
        self.mask, self.by_gram = np.uint64(slots - 1), by_gram
        self.tuple_gram, self.tuple_cover, self.gram, self.cover = (np.zeros(slots, np.uint64) for _ in range(4))
        self.place = np.full((3, slots), np.iinfo(np.int64).max)
        self.n, self.several = np.zeros(slots, np.int64), np.zeros(slots, bool)

    def earlier(self, gram: np.ndarray, cover: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the task has dealt an equal tuple with an earlier place. The others are remembered."""
        slot = (mixed(gram ^ mixed(cover)) & self.mask).astype(np.int64)
        known = self.place[:, slot]
        before = (known[0] < place[0]) | ((known[0] == place[0]) & ((known[1] < place[1]) | ((known[1] == place[1]) & (known[2] < place[2]))))
        hit = (self.tuple_gram[slot] == gram) & (self.tuple_cover[slot] == cover) & before
        new = ~hit
        self.tuple_gram[slot[new]], self.tuple_cover[slot[new]], self.place[:, slot[new]] = gram[new], cover[new], place[:, new]
        return hit

    def crowded(self, gram: np.ndarray, cover: np.ndarray) -> np.ndarray:
        """Whether the task has dealt `by_gram` tuples of the gram, with two coverings at least. gram is sorted."""
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        count = np.diff(np.concatenate((first, [len(gram)])))
        slot = (gram[first] & self.mask).astype(np.int64)
        known = self.gram[slot] == gram[first]
        base, several = np.where(known, self.n[slot], 0), known & self.several[slot]
        out = np.repeat(several & (base >= self.by_gram), count)
        head = np.where(known, self.cover[slot], cover[first])
        other = np.add.reduceat((cover != np.repeat(head, count)).astype(np.int64), first) > 0
        kept = known | (self.n[slot] < self.by_gram)  # a crowded gram keeps its slot
        at = slot[kept]
        self.gram[at], self.cover[at], self.n[at], self.several[at] = gram[first][kept], head[kept], (base + count)[kept], (several | other)[kept]
        return out


def _tuples(slots: int = SLOTS, by_gram: int = BY_GRAM):
    """The chunks' tuples. Those that repeat an earlier one of the task are settled here and dealt anywhere, so that of many
    copies few per task meet. Of grams with many coverings, a task deals some by the gram and the others by gram and
    covering: all of them are open, since the gram has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(slots, by_gram)
        for batch in batches:
            for k in range(batch.num_rows):
                c = _Chunk(batch, k)
                start, n, gram, cover = anchors(c.data, c.ends)
                if not len(start):
                    continue
                doc = c.order[np.searchsorted(c.ends, start, side="right")]
                by = np.lexsort((start, doc, cover, gram))
                start, n, gram, cover, doc = start[by], n[by], gram[by], cover[by], doc[by]
                kind = np.zeros(len(start), np.int8)
                kind[1:][(gram[1:] == gram[:-1]) & (cover[1:] == cover[:-1])] = SETTLED
                new = np.flatnonzero(kind == PLAIN)
                place = np.stack([doc[new], np.full(len(new), c.chunk), start[new]])
                kind[new[seen.earlier(gram[new], cover[new], place)]] = SETTLED
                new = np.flatnonzero(kind == PLAIN)
                if len(new):
                    kind[new[seen.crowded(gram[new], cover[new])]] = CROWDED
                anywhere = mixed(np.uint64(c.chunk) * np.uint64(CHUNK_BYTES) + start.astype(np.uint64))
                gram = np.where(kind == SETTLED, anywhere, gram)
                yield _batch(TUPLE, [_signed(gram), _signed(cover), doc, np.full(len(start), c.chunk), start, n, kind])

    return run


def _ends(slots: int = SLOTS):
    """The covered bytes of the chunk's open tuples; of grams with too many coverings, hashes of each string. Strings that
    repeat an earlier one of the task are settled here, as runs without hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(slots)
        for batch in batches:
            for k in range(batch.num_rows):
                c = _Chunk(batch, k)
                pos, n, gram, many = (_runs(batch, "open", k, f) for f in ("pos", "n", "gram", "many"))
                doc = c.order[np.searchsorted(c.ends, pos, side="right")]
                few = many == 0
                if few.any():
                    data = [c.data[a : a + m + WIDTH - 1].tobytes() for a, m in zip(pos[few].tolist(), n[few].tolist(), strict=True)]
                    none = [None] * len(data)
                    yield _batch(ENDS, [gram[few], doc[few], np.full(len(data), c.chunk), pos[few], n[few], data, none, none])
                if few.all():
                    continue
                pos, n, gram, doc = pos[~few], n[~few], gram[~few], doc[~few]
                at, home = _spread(pos, n)
                both = np.array([np.frombuffer(hashlib.blake2b(c.data[a : a + WIDTH].tobytes(), digest_size=16).digest(), "<u8") for a in at.tolist()])
                first, second = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
                by = np.lexsort((at, doc[home], second, first))
                settled = np.zeros(len(at), bool)
                settled[by[1:]] = (first[by][1:] == first[by][:-1]) & (second[by][1:] == second[by][:-1])
                new = np.flatnonzero(~settled)
                settled[new] = seen.earlier(first[new], second[new], np.stack([doc[home[new]], np.full(len(new), c.chunk), at[new]]))
                i = np.flatnonzero(settled)
                if len(i):  # neighbours of one tuple are one run
                    cut = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1] + 1) | (home[i[1:]] != home[i[:-1]]))))
                    head, none = i[cut], [None] * len(cut)
                    yield _batch(ENDS, [gram[home[head]], doc[home[head]], np.full(len(head), c.chunk), at[head], np.diff(np.append(cut, len(i))), none, none, none])
                i = np.flatnonzero(~settled)
                none = [None] * len(i)
                yield _batch(
                    ENDS,
                    [gram[home[i]], doc[home[i]], np.full(len(i), c.chunk), at[i], np.ones(len(i), np.int64), none, _signed(first[i]), _signed(second[i])],
                )

    return run


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, .. n times each, and from which run each comes."""
    home = np.repeat(np.arange(len(n)), n)
    return start[home] + np.arange(len(home)) - np.repeat(np.cumsum(n) - n, n), home


def _compared(at_once: int = STRINGS):
    """Tuples in order of their gram, all of a gram's together: strings that are equal to an earlier one, as runs. Some
    grams are worked on at a time, so a task holds no more than those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        strings = 0
        for batch in batches:
            waiting.append(batch)
            strings += int(batch.column("n").to_numpy().sum())
            if strings >= at_once:
                table = pa.Table.from_batches(waiting).combine_chunks()
                gram = table.column("gram").to_numpy()
                last = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on in the next batch
                if last:
                    yield from _repeated(table.slice(0, last))
                    waiting = table.slice(last).to_batches()
                    strings = int(table.column("n").to_numpy()[last:].sum())
        if waiting:
            yield from _repeated(pa.Table.from_batches(waiting))

    return run


def _repeated(whole: pa.Table) -> Iterator[pa.RecordBatch]:
    if not whole.num_rows:
        return
    gram, doc, chunk, pos, n = (whole.column(x).to_numpy() for x in ("gram", "doc", "chunk", "pos", "n"))
    order = np.lexsort((pos, chunk, doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    data = whole.column("data").to_pylist()
    n = n.astype(np.int64)
    sizes = np.array([len(d) for d in data])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at, home = _spread(starts, n)
    text = np.frombuffer(b"".join(data), np.uint8)
    string = np.empty(len(at), np.uint64)
    cuts = [0, *(np.flatnonzero(np.diff(starts // SEGMENT)) + 1).tolist(), len(data)]  # some bytes at a time
    for a, b in zip(cuts, cuts[1:], strict=False):
        low, high = starts[a], starts[b] if b < len(data) else len(text)
        hashed = Hashed(text[low:high])
        first, last = np.searchsorted(home, (a, b))
        here = at[first:last] - low
        string[first:last] = mixed(hashed.of(here, here + WIDTH))
    by = np.lexsort((at - starts[home], rank[home], gram[home], string))
    same = np.concatenate(([False], (string[by][1:] == string[by][:-1]) & (gram[home][by][1:] == gram[home][by][:-1])))
    if not _equal_bytes(text, at[by][np.flatnonzero(same)], at[by][np.flatnonzero(same) - 1]):  # two strings with one hash
        known: dict[bytes, None] = {}
        by = np.lexsort((at - starts[home], rank[home]))
        first = [text[x : x + WIDTH].tobytes() for x in at[by].tolist()]
        same = np.array([x in known or known.setdefault(x) is not None for x in first])
    gone = np.zeros(len(at), bool)
    gone[by[same]] = True
    # neighbouring strings of one tuple become one run
    i = np.flatnonzero(gone)
    if len(i):
        cut = np.concatenate(([True], (i[1:] != i[:-1] + 1) | (home[i[1:]] != home[i[:-1]])))
        first = i[cut]
        count = np.diff(np.concatenate((np.flatnonzero(cut), [len(i)])))
        yield _batch(RUN, [chunk[home[first]], pos[home[first]] + (at - starts[home])[first], count])


def _equal_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the strings at a and b are equal, pair by pair."""
    windows = np.lib.stride_tricks.sliding_window_view(text, WIDTH)
    return all((windows[a[k : k + 4096]] == windows[b[k : k + 4096]]).all() for k in range(0, len(a), 4096))


def _removed(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c = _Chunk(batch, k)
                gone = covered(_runs(batch, "gone", k, "pos"), _runs(batch, "gone", k, "n"), len(c.data))
                out: list[list] = [[], [], [], [], []]
                a = 0
                for name, b in zip(c.ids, c.ends.tolist(), strict=True):
                    mark = gone[a:b]
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0]))))
                    kept = c.data[a:b][~mark].tobytes()
                    spans = [{"start": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                    last = (len(spans), hashlib.sha256(kept).hexdigest()) if digest else (spans, kept)
                    for column, value in zip(out, (name, b - a, int(mark.sum()), *last), strict=True):
                        column.append(value)
                    a = b
                yield _batch(DIGEST if digest else RESULT, out)

    return run


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", meeting: int = MEETING, digest: bool = False,
    slots: int = SLOTS, by_gram: int = BY_GRAM, strings: int = STRINGS,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, spans (removed byte ranges) and kept (the remaining bytes); with
    `digest` n_spans and kept_sha256 instead of the last two.

    Coverings are compared by 64 bits of their anchor's gram and 64 of all their bytes, strings of few coverings by their
    bytes, and strings of many by the gram and 128 bits. Texts are packed into chunks and written once; chunks, not
    documents, meet the findings. Tuples are dealt by gram and sorted by Spark, which spills; equal coverings, such as
    those of many copies, are settled within a task, then there. Of a gram with many coverings, such as one at the edge of
    a passage that very many documents have, a task deals BY_GRAM by the gram and the others by covering, so the gram is
    no hot key; its strings are settled within a task, then grouped and joined one by one. Else the bytes of open tuples meet by gram, `meeting`
    coverings at most.

    Null text is empty; a very long text is one chunk. A null id comes before all others. Rows with one id are ordered as
    they were read. Other columns are ignored; an empty table gives no rows.
    """
    chunks = stored(_mapped(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), _chunks, CHUNK))
    place = ("doc", "chunk", "pos")
    equal = Window.partitionBy("deal", "cover").orderBy(*place)
    coverings = Window.partitionBy("deal").orderBy("cover")
    deal = F.when(F.col("kind") == CROWDED, F.xxhash64("gram", "cover")).otherwise(F.col("gram"))
    tuples = (
        _mapped(chunks, _tuples(slots, by_gram), TUPLE)
        .withColumn("deal", deal)
        .withColumn("nth", F.row_number().over(equal))
        .withColumn("covering", F.dense_rank().over(coverings))
        .withColumn("coverings", F.max("covering").over(Window.partitionBy("deal")))
    )
    settled, crowded = F.col("kind") == SETTLED, F.col("kind") == CROWDED
    found = stored(
        tuples.where(settled | crowded | F.expr("nth > 1 OR coverings > 1")).select(
            "chunk", "pos", "n", "gram", (settled | (F.col("nth") > 1)).alias("gone"), (crowded | (F.col("coverings") > meeting)).alias("crowd")
        )
    )
    left = found.where("NOT gone")
    crowds = left.where("crowd").select("gram", F.lit(1).alias("many")).distinct()
    open_ = (
        left.drop("crowd").join(crowds, "gram", "left").withColumn("many", F.coalesce("many", F.lit(0)))
        .groupBy("chunk").agg(F.collect_list(F.struct("pos", "n", "gram", "many")).alias("open"))
    )
    ends = stored(_mapped(chunks.join(open_, "chunk"), _ends(slots), ENDS))
    few = _mapped(ends.where("data IS NOT NULL").repartition(F.col("gram")).sortWithinPartitions("gram"), _compared(strings), RUN)
    single = ends.where("string1 IS NOT NULL")
    known = ends.where("data IS NULL AND string1 IS NULL").select("chunk", "pos", "n")
    string = ["gram", "string1", "string2"]
    earliest = single.groupBy(*string).agg(F.min(F.struct(*place)).alias("first"))
    many = single.join(earliest, string).where(F.struct(*place) != F.col("first")).select("chunk", "pos", "n")
    gone = (
        found.where("gone").select("chunk", "pos", "n").unionByName(known).unionByName(few).unionByName(many)
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("pos", "n")).alias("gone"))
    )
    result = _mapped(chunks.join(gone, "chunk", "left"), _removed(digest), DIGEST if digest else RESULT)
    return result.withColumnRenamed("id", id_col)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
