"""Mixing sources to target weights: a temperature found by bisection, realised as budgeted block permutations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from millrace.llm.common import stored, table

#: Entropy that the weights shall reach, as a share of the entropy of equal weights.
TARGET_ENTROPY = 0.9
#: No source is read more often than this.
MAX_EPOCHS = 4.0
#: Documents of all sources in a bucket of the hash, in the mean; a block is a bucket of one source.
BUCKET_DOCS = 2048
#: A row that repeats more often than a bucket holds, and than in one of so many rows, is dealt copy by copy: there are fewer such rows than this.
HOT_ROWS = 100_000
#: Copies of a row that one row stands for until they are dealt.
RUN = 4096
BISECTIONS = 60
SEED = 17
#: Stands for a missing source.
NO_SOURCE = "\x00"


def _sum(xs: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + of(x))


def _entropy(p: Column, power: Column) -> Column:
    """Of the weights p^power / z, in nats: log z less the mean of power * log p."""
    z = _sum(p, lambda x: F.pow(x, power))
    return F.log(z) - power * _sum(p, lambda x: F.pow(x, power) * F.log(x)) / z


def _repetition(p: Column, power: Column) -> Column:
    """How often the smallest source is read when the largest is read once: weight over share is p^(power - 1)."""
    return F.pow(F.array_min(p) / F.array_max(p), power - 1)


def _boundary(holds: Callable[[Column], Column]) -> Column:
    """The largest power in [0, 1] for which holds(power) is true; it is true below some power and false above."""

    def halve(s: Column, _: Column) -> Column:
        tried = F.transform(
            F.array((s["lo"] + s["hi"]) / 2),
            lambda m: F.transform(
                F.array(holds(m)),
                lambda yes: F.struct(F.when(yes, m).otherwise(s["lo"]).alias("lo"), F.when(yes, s["hi"]).otherwise(m).alias("hi")),
            )[0],
        )
        return tried[0]

    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(BISECTIONS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve
    )
    return F.when(holds(F.lit(1.0)), F.lit(1.0)).otherwise(found["lo"])


def target_weights(totals: DataFrame, *, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """From (source, tokens): one row per source with its tokens, the power, its weight and its epochs.

    Weights are shares raised to a power and normalised. The power is the largest in [0, 1] whose weights reach the
    target entropy; if a source would then be read more than `max_epochs` times, it is the one that just meets this
    limit. Both are found by bisection. Epochs are scaled so that the source that is read least is read once: no document
    is left out. Sources without tokens get weight 0 and one epoch.

    The sources meet in one row, a number for each; documents don't.
    """
    p, n = F.col("p"), F.size("p").cast("double")
    one = totals.agg(F.collect_list(F.struct("source", "tokens")).alias("xs")).withColumn(
        "ts", F.array_sort(F.filter(F.transform("xs", lambda x: x["tokens"].cast("double")), lambda t: t > 0))
    )
    one = one.withColumn("total", F.aggregate("ts", F.lit(0.0), lambda a, t: a + t)).withColumn(
        "p", F.transform("ts", lambda t: t / F.col("total"))
    )
    one = one.withColumn("free", _boundary(lambda m: _entropy(p, m) >= target_entropy * F.log(n)))
    one = one.withColumn(
        "power",
        F.when(F.size("p") < 2, F.lit(1.0))
        .when(_repetition(p, F.col("free")) > max_epochs, _boundary(lambda m: _repetition(p, m) > max_epochs))
        .otherwise(F.col("free")),
    ).withColumn("z", _sum(p, lambda x: F.pow(x, F.col("power"))))
    x = F.col("x")
    share = x["tokens"] / F.col("total")
    some = x["tokens"] > 0
    return one.select(F.explode("xs").alias("x"), "total", "p", "power", "z").select(
        x["source"].alias("source"),
        x["tokens"].alias("tokens"),
        "power",
        F.when(some, F.pow(share, F.col("power")) / F.col("z")).otherwise(0.0).alias("weight"),
        F.when(some, F.pow(share / F.array_max("p"), F.col("power") - 1)).otherwise(1.0).alias("epochs"),
    )


def _copies_dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows, with a hash of its own for each copy of those in hot(h, g), which are fewer than HOT_ROWS.

    Copies are counted, not numbered where they stand: tasks pass on one row and a count, and what is made of it doesn't
    depend on the order of rows, so a task that is run again gives the same.
    """
    mark = F.broadcast(hot)
    others = rows.join(mark, ["h", "g"], "left_anti")
    same = rows.join(mark, ["h", "g"], "left_semi").groupBy("h", "g", "source", "tokens").agg(F.first("row").alias("row"), F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number, which isn't merged into few again
    runs = same.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN)))).repartition(parts, "h", "run")
    each = runs.withColumn("nth", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("n")) - 1)))
    return others.unionByName(each.withColumn("h", F.xxhash64("h", "nth")).select(*others.columns))


def mix_sources(
    docs: DataFrame,
    *,
    text_col: str = "text",
    source_col: str = "source",
    carry: list[str] | None = None,
    whole_rows: bool = False,
    target_entropy: float = TARGET_ENTROPY,
    max_epochs: float = MAX_EPOCHS,
) -> DataFrame:
    """A row for each time a document is read: the columns `carry`, then mix_source, mix_weight, mix_epoch, mix_block,
    mix_place and mix_at. With `whole_rows`, the input's row as the struct `row` instead of `carry`.

    A source's documents are dealt to blocks by a hash of the row; the copies of a row that is very often there have
    hashes of their own (not so with `whole_rows` over columns of maps or variants, which can't be compared). In each epoch its blocks are permuted, and the
    documents within a block. Whole epochs read all; the last one reads blocks until the source's budget (its epochs
    times its tokens) is used up, and of the block where that happens the documents that still fit. mix_at is the part of
    the source's budget that was read before the block: ordering by it interleaves the sources at their weights from
    start to end.

    Tokens are words here, not ids of a tokenizer: shares of words stand in for shares of ids. Totals are summed per source and block before they are shuffled; windows run over the blocks of a
    source (a row per some thousand documents) and over the documents of one block, never over those of a source, so a
    source with most of the rows is dealt like any other. Each document is read at least once.

    Null text has no words, very long ones are counted whole; a null source is a source of its own; null ids and repeated
    rows are rows like others. Other columns of any name are ignored or, with `whole_rows`, carried; columns named mix_*
    must not be in `carry`. An empty table gives no rows.
    """
    carry = ["doc_id"] if carry is None else carry
    kept = [f.name for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))] if whole_rows else carry
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    rows = docs.select(
        (F.struct("*") if whole_rows else F.struct(*carry)).alias("row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
        *(F.xxhash64(F.lit(SEED + k), *map(quoted, dict.fromkeys([*kept, text_col]))).alias(c) for k, c in enumerate("hg")),
    )
    slim = stored(rows.select("source", "tokens", "h", "g"))
    total = slim.count()
    buckets = max(1, -(-total // BUCKET_DOCS))
    if len(kept) == len(docs.columns if whole_rows else carry):
        hot = stored(slim.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") > max(BUCKET_DOCS, total / HOT_ROWS)).select("h", "g"))
        if not hot.isEmpty():
            rows = _copies_dealt(rows, hot)
            slim = stored(rows.select("source", "tokens", "h"))
    bucket = F.pmod("h", F.lit(buckets)).alias("block")
    blocks = slim.groupBy("source", bucket).agg(F.sum("tokens").alias("tokens"))
    weights = target_weights(
        slim.groupBy("source").agg(F.sum("tokens").alias("tokens")), target_entropy=target_entropy, max_epochs=max_epochs
    )
    epoch = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs") - 1, F.lit(0)).cast("int"))).alias("epoch")
    permuted = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(SEED), "source", "epoch", "block"), "block")
    budget = (F.col("epochs") - F.col("epoch")) * F.col("total")
    plan = (
        blocks.join(weights.select("source", "weight", "epochs", F.col("tokens").alias("total")), "source")
        .select("*", epoch)
        .withColumn("before", F.sum("tokens").over(permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
        .withColumn("take", F.when(F.col("epoch") + 1 > F.col("epochs"), budget - F.col("before")))
        .where("take IS NULL OR take > 0")
        .select(
            "source", "block", "weight", "epoch", "take",
            ((F.col("epoch") + F.coalesce(F.col("before") / F.nullif("total", F.lit(0)), F.lit(0.0))) / F.col("epochs")).alias("at"),
        )
    )
    within = Window.partitionBy("source", "block", "epoch").orderBy(F.xxhash64("h", "epoch"), "h", "tokens")
    read = (
        rows.withColumn("block", F.pmod("h", F.lit(buckets)))
        .join(plan, ["source", "block"])
        .withColumn("place", F.row_number().over(within))
        .withColumn("upto", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where("take IS NULL OR upto <= take")
    )
    return read.select(
        "row" if whole_rows else "row.*",
        F.nullif("source", F.lit(NO_SOURCE)).alias("mix_source"),
        F.col("weight").alias("mix_weight"),
        F.col("epoch").alias("mix_epoch"),
        F.col("block").alias("mix_block"),
        F.col("place").alias("mix_place"),
        F.col("at").alias("mix_at"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
