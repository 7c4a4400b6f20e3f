"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from millrace.llm import minhash as m
from millrace.llm.common import NO_ID, held, small_batches, stored, table
from millrace.llm.components import components

SIMILARITY = 0.8
SLICES = 256
#: Turns at most in which a text is compared with one text of another component.
TURNS = 2
#: After that, with one of so many texts of other components; at last with all.
SHARES = (16, 1)
#: Pairs, of all texts that meet, that are compared at once without these turns.
FEW_PAIRS = 50_000
#: Distinct shingles that a task counts before it hands on what it has.
HELD_SHINGLES = 1 << 20

_LONG = pa.int64()
COUNTS = pa.schema({"slice": pa.int32(), "counts": pa.binary()}.items())
SIGNED = pa.schema({"doc": _LONG, "same": pa.binary(), "bands": pa.list_(_LONG)}.items())
NUMBERS = pa.schema({"shingle": _LONG, "n": _LONG}.items())
WEIGHTS = pa.schema({"doc": _LONG, "shingle": _LONG, "weight": pa.float64()}.items())
SCORED = pa.schema({"a": _LONG, "b": _LONG, "similarity": pa.float64()}.items())

def _sampler() -> m.Sampler:
    return held("sampler", m.Sampler)


def _entry_counts(texts: DataFrame, bits: int) -> np.ndarray:
    """How many documents have a shingle of each entry: tasks count in a table of fixed size, slices are added up by Spark.

    What comes to the driver is the table: 2^bits numbers, whatever the input.
    """
    per = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(total, np.unique(m.entries(m.shingles(text), bits)), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.reshape(SLICES, per)])], schema=COUNTS
            )

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(per, np.int64)
        for x in group.column("counts"):
            total += np.frombuffer(x.as_py(), "<i8")
        return pa.table({"slice": group.column("slice")[:1], "counts": pa.array([total.tobytes()])}, schema=COUNTS)

    out = np.zeros((SLICES, per), np.int64)
    schema = from_arrow_schema(COUNTS)
    for row in texts.select("text").mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return out.ravel()


def frequencies(texts: DataFrame, n_docs: int, *, bits: int = m.DF_BITS, one_in: int = m.FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and in how many documents each stands.

    A frequent shingle's entry has at least its count, so the entries below that are left out, and the shingles of the
    others are counted one by one: first in the task, then by Spark. What comes to the driver is bounded (see FREQUENT).
    """
    least = n_docs / one_in
    may = texts.sparkSession.sparkContext.broadcast(_entry_counts(texts, bits) > least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n_seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        new: list[np.ndarray] = []

        def merged() -> None:
            nonlocal seen, n_seen
            every, place = np.unique(np.concatenate([seen, *new]), return_inverse=True)
            n_seen = np.bincount(place, np.concatenate([n_seen, np.ones(len(place) - len(seen), np.int64)]), len(every)).astype(np.int64)
            seen = every
            new.clear()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n_seen)], schema=NUMBERS)

        waiting = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                h = m.shingles(text)
                new.append(np.unique(h[may.value[m.entries(h, bits)]]))
                waiting += len(new[-1])
                if waiting >= HELD_SHINGLES // 4:
                    merged()
                    waiting = 0
                    if len(seen) >= HELD_SHINGLES:
                        yield counted()
                        seen, n_seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        merged()
        if len(seen):
            yield counted()

    rows = texts.select("text").mapInArrow(count, from_arrow_schema(NUMBERS)).groupBy("shingle").agg(F.sum("n").alias("n"))
    found = rows.where(F.col("n") > least).toArrow()
    h = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], found.column("n").to_numpy()[order]


def inverse_frequencies(texts: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """idf of the frequent shingles, as weighted() reads it."""
    h, n = frequencies(texts, n_docs)
    return h, m.idf_values(n, n_docs)


def text_key(text: str) -> Column:
    """What equal texts share: 128 bits of a hash, no bytes for a null."""
    return F.coalesce(F.substring(F.unhex(F.sha2(text, 256)), 1, 16), F.lit(b""))


def signed(texts: DataFrame, idf) -> DataFrame:
    """doc, same (what exact copies share) and bands of each text's samples; no bands where it has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_of = batch.column("text").to_pylist()
            worded: list[bool] = []
            sets: list[tuple[np.ndarray, np.ndarray]] = []
            drawn = [np.zeros((0, m.HASHES), np.uint64)]
            for k, text in enumerate(texts_of):
                sets.append(m.weighted(text, idf.value))
                worded.append(len(sets[-1][0]) > 0)
                if not worded[-1]:
                    sets.pop()
                if sets and (len(sets) == 32 or k == len(texts_of) - 1):
                    drawn.append(_sampler().signatures(sets))
                    sets = []
            found = m.bands(np.concatenate(drawn)).view(np.int64)
            ends = np.cumsum(np.array(worded) * found.shape[1])
            listed = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(found.ravel(), _LONG))
            columns = [batch.column("doc"), batch.column("same"), listed]
            yield pa.RecordBatch.from_arrays(columns, schema=SIGNED)

    return texts.mapInArrow(run, from_arrow_schema(SIGNED))


def _verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """Pairs whose texts' weighted Jaccard similarity reaches the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)  # a's shingles: its pairs stand together
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            score = []
            for k, doc in enumerate(a):
                if doc != last[0]:
                    last = (doc, m.weighted(batch.column("text_a")[k].as_py(), idf.value))
                score.append(m.jaccard(last[1], m.weighted(batch.column("text_b")[k].as_py(), idf.value)))
            keep = [x >= similarity for x in score]
            if any(keep):
                yield pa.RecordBatch.from_arrays([pa.array(a, _LONG), pa.array(b, _LONG), pa.array(score)], schema=SCORED).filter(pa.array(keep))

    side = lambda x: texts.select(F.col("doc").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(run, from_arrow_schema(SCORED))


def _texts_of(texts: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of these numbers. How many there are follows the input, so they are not broadcast at any size."""
    named = nodes.join(wanted.select(F.col("doc").alias("node")), "node", "left_semi").select(F.col("first").alias("doc"), "same", "node")
    found = texts.join(named.hint("merge"), ["doc", "same"]).groupBy("doc", "same").agg(F.min("node").alias("node"), F.min("text").alias("text"))
    return found.select(F.col("node").alias("doc"), "text")


def _meetings(crowd: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """shingle, doc, total, rest: where texts meet that can be alike, by an exact prefix filter instead of all pairs.

    Each text's shingles are ordered from the rarest among these texts to the most common. Alike texts x and y share at
    least t / (1 + t) of what both weigh together, t being the similarity. All that they share comes from their first
    shared shingle on, so what each weighs from there on (rest) is as much: for the lighter of them 2 t / (1 + t) of its
    total at least, for the other one t. Near copies with edits of their own beyond that don't meet, however many they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h, w = m.weighted(text, idf.value)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), doc)), pa.array(h.view(np.int64)), pa.array(w.astype(np.float64))], schema=WEIGHTS)

    rows = stored(texts.join(crowd.select("doc"), "doc", "left_semi").mapInArrow(run, from_arrow_schema(WEIGHTS)))
    df = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    text = Window.partitionBy("doc")
    rarest = text.orderBy("df", "shingle")
    return stored(
        rows.join(df, "shingle", "left")  # a shingle of one text comes first, and nobody meets it
        .withColumn("df", F.coalesce("df", F.lit(1)))
        .withColumn("total", F.sum("weight").over(text))
        .withColumn("rest", F.col("total") - F.sum("weight").over(rarest) + F.col("weight"))
        .where((F.col("df") > 1) & (F.col("rest") >= F.col("total") * _bound(similarity)))
        .select("shingle", "doc", "total", "rest")
    )


def _bound(similarity: float) -> float:
    """A little less than the similarity, so that rounded weights lose no pair."""
    return similarity * (1 - 1e-6)


def _sides(meetings: DataFrame, labels: DataFrame, similarity: float) -> tuple[DataFrame, Callable[[str, DataFrame], DataFrame], Column]:
    """Meetings of several components, whether their text is of the one that has most texts there (major); how to name the
    two sides of a pair; and whether the pair can be alike."""
    labelled = meetings.join(labels, "doc")
    parts = labelled.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    most = parts.groupBy("shingle").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    here = labelled.join(most.drop("labels"), "shingle").withColumn("major", F.col("label") == F.col("most")).drop("most")
    side = lambda x, df: df.select("shingle", *(F.col(c).alias(f"{x}_{c}") for c in ("doc", "label", "total", "rest")))
    t = _bound(similarity)
    may = F.least("x_rest", "y_rest") >= (F.col("x_total") + F.col("y_total")) * (t / (1 + t))
    return here, side, may


def _one_each(meetings: DataFrame, labels: DataFrame, similarity: float, turn: int) -> DataFrame:
    """For each text that is not of the major component where it meets it, one pair (a, b) with a text b that is."""
    here, side, may = _sides(meetings, labels, similarity)
    lot = lambda *c: F.xxhash64(*c, F.lit(turn))
    leads = here.where("major").groupBy("shingle").agg(F.min_by(F.struct("doc", "label", "total", "rest"), lot("doc")).alias("y"))
    lead = leads.select("shingle", *(F.col(f"y.{c}").alias(f"y_{c}") for c in ("doc", "label", "total", "rest")))
    met = side("x", here.where("NOT major")).join(lead, "shingle").where(may)
    return met.groupBy(F.col("x_doc").alias("a")).agg(F.min_by("y_doc", lot("shingle")).alias("b"))


def _all_apart(meetings: DataFrame, labels: DataFrame, similarity: float, one_in: int = 1) -> DataFrame:
    """All pairs (a, b) of different components that meet and can be alike, or with one text in so many as the heavier one
    or the one of the major component, which doesn't meet itself."""
    here, side, may = _sides(meetings, labels, similarity)
    t = _bound(similarity)
    light = here.where(F.col("rest") >= F.col("total") * (2 * t / (1 + t)))
    apart = (F.col("x_label") != F.col("y_label")) & (F.col("x_total") <= F.col("y_total")) & may
    some = F.pmod(F.xxhash64("doc"), F.lit(one_in)) == 0
    minor = side("x", light.where("NOT major")).join(side("y", here.where(some)), "shingle").where(apart)
    major = side("x", light.where("major").where(some)).join(side("y", here.where("NOT major")), "shingle").where(apart)
    return minor.unionByName(major).select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct()


def _relabelled(labels: DataFrame, links: DataFrame, *, towards_b: bool) -> DataFrame:
    """Labels of texts after links between some of them: components meet as one or, `towards_b`, that of a takes the label of
    that of b. What the latter leaves apart is compared once more and linked in the end."""
    of = lambda x: labels.select(F.col("doc").alias(x), F.col("label").alias(f"label_{x}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    joined = between.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")) if towards_b else components(between)
    renamed = joined.select(F.col("id").alias("label"), F.col("label").alias("renamed"))
    return stored(labels.join(renamed, "label", "left").select("doc", F.coalesce("renamed", "label").alias("label")))


def _crowd_links(crowd: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame | None:
    """Links (a, b) between texts (doc, label) of different components, enough that those that are alike become one.

    In a family of near copies, most pairs of components would be found alike many times over. So there are some turns
    first, in each of which a text is compared with one of another component, then one with a share of the other texts;
    what is then still apart is compared in full. The turns change the cost and not the components, so where all pairs that
    meet are few, these are compared at once.
    """
    meetings = _meetings(crowd, texts, idf, similarity)
    labels, found = crowd, None
    held = meetings.groupBy("shingle").agg(F.count("*").alias("n"))
    if (held.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first().pairs or 0) <= FEW_PAIRS:
        links = stored(_verified(stored(_all_apart(meetings, labels, similarity)), texts, idf, similarity).select("a", "b"))
        return None if links.isEmpty() else links
    for turn in range(TURNS):
        pairs = stored(_one_each(meetings, labels, similarity, turn))
        links = stored(_verified(pairs, texts, idf, similarity).select("a", "b"))
        n = links.count()
        if n:
            found = links if found is None else found.unionByName(links)
            labels = _relabelled(labels, links, towards_b=True)
        if n < pairs.count() / 8:
            break
    for one_in in SHARES:
        pairs = stored(_all_apart(meetings, labels, similarity, one_in))
        links = stored(_verified(pairs, texts, idf, similarity).select("a", "b"))
        if not links.isEmpty():
            found = links if found is None else found.unionByName(links)
            labels = _relabelled(labels, links, towards_b=False) if one_in > 1 else labels
    return found


def _linked(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """base(doc, text, same), every (what signed() gives), nodes(same, first, node), links(a, b), labels(id, label).

    A node is a distinct text; first is the least id of a document that has it. Links and labels are of nodes.
    """
    spark = small_batches(docs).sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    base = base.withColumn("same", text_key("text"))
    texts = base.where("text IS NOT NULL AND text <> ''")
    idf = spark.sparkContext.broadcast(inverse_frequencies(texts, base.count()))  # frequent shingles: of bounded number
    every = stored(signed(texts, idf))
    # written once, so that each text keeps its number
    nodes = stored(every.groupBy("same").agg(F.min("doc").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    own = every.join(nodes.select(F.col("first").alias("doc"), "same", "node"), ["doc", "same"]).dropDuplicates(["doc", "same"])
    # from here on, doc is a text's number
    member = own.select(F.col("node").alias("doc"), F.explode("bands").alias("bucket")).distinct()
    buckets = member.groupBy("bucket").agg(F.min("doc").alias("lead"), F.count("*").alias("n")).where("n > 1")
    met = stored(member.join(buckets.select("bucket", "lead"), "bucket").select("bucket", "doc", "lead"))
    star = stored(met.where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct())
    # texts of documents that may be alike to another, each once
    read = stored(_texts_of(texts, nodes, met.select("doc").distinct()))
    first = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stored(_verified(first, read, idf, similarity).select("a", "b"))
    labels = components(links)

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of documents that are in different components so far."""
        of = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"label_{x}"))
        own = lambda x: F.coalesce(f"label_{x}", x)
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(own("a") != own("b")).select("a", "b")

    more = stored(_verified(apart(star.join(first, ["a", "b"], "left_anti"), labels), read, idf, similarity).select("a", "b"))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    # members of buckets in which more than one component is left
    mine = met.join(labels.select(F.col("id").alias("doc"), "label"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    open_ = mine.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    crowd = stored(mine.join(open_, "bucket").select("doc", "label").distinct())
    if not crowd.isEmpty() and (more := _crowd_links(crowd, read, idf, similarity)) is not None:
        links = links.unionByName(more)
        labels = components(links)
    return base, every, nodes, links, labels


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One row per id: id and group_id, the least id of the documents it is linked to (its own if there are none).

    Texts are linked if they are equal, or if their shingles' weighted Jaccard similarity is at least `similarity`;
    groups are what links connect. Exact copies are one text from the start. Candidates share a band of samples. The
    links of a band's bucket are settled without all its pairs: first every member against the bucket's first text, then,
    once what is linked so far is one component, members of different components against each other, by an exact prefix
    filter (see _crowd_links). A pair inside a component would change nothing, so no candidate's link is lost.

    Null and empty texts stay alone; texts without words are only linked to equal ones. Very long texts are hashed whole,
    a piece at a time. Rows with a null id are one document (in the result null, null). Rows with one id are one document
    that is linked by each of its texts. Other columns are ignored; an empty table gives no rows.
    """
    base, every, nodes, links, labels = _linked(docs, id_col, text_col, similarity)
    # what a document with several texts links
    several = every.groupBy("doc").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo < hi").select("doc")
    theirs = stored(every.select("doc", "same").join(several, "doc").join(nodes.select("same", "node"), "same").select("doc", "node"))
    if not theirs.isEmpty():
        lead = theirs.groupBy("doc").agg(F.min("node").alias("a"))
        labels = components(links.unionByName(theirs.join(lead, "doc").select("a", F.col("node").alias("b"))))
    linked = nodes.join(labels.withColumnRenamed("id", "node"), "node")
    least = linked.groupBy("label").agg(F.min("first").alias("group"))
    groups = nodes.select("same", "first").join(linked.join(least, "label").select("same", "group"), "same", "left")
    grouped = (
        every.select("doc", "same").join(groups, "same")
        .groupBy("doc")
        .agg(F.min(F.coalesce("group", "first")).alias("group"))
    )
    ids = base.select("doc").distinct()
    return ids.join(grouped, "doc", "left").select(
        F.nullif("doc", F.lit(NO_ID)).alias(id_col), F.nullif(F.coalesce("group", "doc"), F.lit(NO_ID)).alias("group_id")
    )


def first_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The texts that stay if of each group of linked texts one does: id and key, as in text_key. It is that of the least id,
    and one without an id only where no text of the group has one.

    Unlike in near_duplicates, texts are not linked by their id: what is no near copy stays under a repeated id as well.
    Null and empty texts stay under each id.
    """
    base, every, nodes, _, labels = _linked(docs, id_col, text_col, similarity)
    named = every.groupBy("same").agg(F.min(F.when(F.col("doc") != NO_ID, F.col("doc"))).alias("id"))
    texts = nodes.select("same", "node").join(named, "same")
    linked = texts.join(labels.withColumnRenamed("id", "node"), "node")
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "same")
    least = linked.groupBy("label").agg(F.min(order).alias("least"))
    later = linked.join(least, "label").where(order != F.col("least")).select("node")
    kept = texts.join(later, "node", "left_anti").select("id", "same")
    silent = base.where("text IS NULL OR text = ''").select(F.nullif("doc", F.lit(NO_ID)).alias("id"), "same").distinct()
    return kept.unionByName(silent).select(F.col("id").alias(id_col), F.col("same").alias("key"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
