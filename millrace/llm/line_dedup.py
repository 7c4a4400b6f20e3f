"""Line dedup: lines that many documents share are dropped, but for one copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import NO_ID, stored, table

BLANKS = " \t\n\x0b\x0c\r"
#: Keys in more than 1/COMMON of all lines meet them without a shuffle.
COMMON = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(bare: Column) -> Column:
    """A-Z lower-cased. lower() is the faster way where all characters are ASCII."""
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def drop_shared_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, kept_text.

    Lines are exploded, their keys hashed (md5), the distinct documents of each hash counted; lines whose key has at
    least `min_chars` code points and stands in at least `min_docs` documents go, except in the largest id that holds
    them. The rest is reassembled by position.

    The exploded lines (hashes, ids and positions) are written once to the shared folder and read for the counts and for
    the second join, so texts are split once. Only those are shuffled for the counts; a key that is in every document arrives
    as one partial count per task. Then the most common keys (at most COMMON, as each holds more than 1/COMMON of all
    lines) meet their lines by broadcast, without a shuffle; the other keys are dealt by hash, and none of them is hot.
    Texts move once, when the positions to drop meet their document. Very long texts are split and joined in time that
    follows their length.

    Null or empty text: one empty line. A null id counts as one document below all others. Rows with equal id and text
    get equal results; rows with one id and several texts count as one document. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("d"), text.alias("t")).withColumn(
        "th", F.unhex(F.md5("t"))
    )
    stripped = F.transform(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    lines = stored(
        base.select("d", "th", F.posexplode(stripped).alias("pos", "bare"))
        .where(F.char_length("bare") >= min_chars)
        .select("d", "th", "pos", F.unhex(F.md5(lowered(F.col("bare")))).alias("h"))
    )
    shared = (
        lines.select("h", "d").distinct().groupBy("h").agg(F.count("*").alias("n"), F.max("d").alias("keeper")).where(F.col("n") >= min_docs)
    )
    shared = stored(shared)  # a row per shared line: read for the common ones, and for the others
    least = lines.count() // COMMON
    common = shared.where(F.col("n") > least).select("h", "keeper")
    few = shared.where(F.col("n") <= least).select("h", F.col("keeper").alias("other"))
    met = lines.join(F.broadcast(common), "h", "left")  # at most COMMON rows: each stands for more than 1/COMMON of all lines
    dropped = (
        met.where("keeper IS NOT NULL AND d <> keeper").select("d", "th", "pos")
        .unionByName(met.where("keeper IS NULL").join(few, "h").where("d <> other").select("d", "th", "pos"))
        .groupBy("d", "th")
        .agg(F.collect_set("pos").alias("gone"))
    )
    parts = F.split("t", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    kept = F.transform(F.array(parts), lambda p: F.transform(left, lambda i: F.get(p, i)))[0]  # the split bound once
    return base.join(dropped, ["d", "th"], "left").select(
        F.col("id").alias(id_col),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_shared_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
r AS (SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
