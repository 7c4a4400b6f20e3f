"""From raw documents to token files: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language_id, mixing, near_dedup, token_store
from millrace.llm.common import NO_ID, shared_dir, stored, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null or without a letter, or with none ahead of the others (all, if no row of docs
    says its language). Rows are judged by their text alone: null ids, repeated rows and other columns don't matter."""
    model = language_id.learn(docs)
    found = language_id.predict(docs, model, whole_rows=True)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") > 0.5)).select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that of the least id stays, or one without an id where no row of the group has one. Rows with
    one id and text are one, whatever else they hold; other texts of a repeated id stay unless they are near copies
    themselves. Null, empty and wordless texts are near copies of none but equal ones: they stay once under each id."""
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias("id")
    first = near_dedup.first_texts(docs).select(known("doc_id"), "key")
    rows = docs.select(known("doc_id"), near_dedup.text_key("text").alias("key"), F.struct("*").alias("row"))
    times = rows.groupBy("id", "key").agg(F.count("*").alias("n"))  # partial counts: a row that is very often there is no hot key
    kept = rows.join(first.join(times, ["id", "key"]), ["id", "key"])
    repeated = kept.where("n > 1").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.where("n = 1").select("row.*").unionByName(repeated.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if a twentieth of their words or more stand in windows of the benchmark. Null, empty and wordless texts
    stay; rows are judged one by one."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), whole_rows=True)
    return found.where(f"NOT ({decontaminate.RULE})").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is read, so that the sources reach their weights; each is read at least once.

    Of the mix, how often a document is read is what the next stage sees: its files are in ascending order of id, so the
    order of blocks is not kept in them. mix_sources gives it to a reader that wants it. A null source is one source.
    """
    return mixing.mix_sources(docs, whole_rows=True).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, and from them a row for each document in them: doc_id, start, n_tokens, ids_crc32. A null text is
    empty, null ids come first, repeated rows are all written."""
    out = shared_dir(spark)
    token_store.write_tokens(docs, out, token_store.tokenizer_path())
    return token_store.read_tokens(spark, out, digest_only=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix),
    ("token_store", write_tokens),
]
#: Language models, near duplicates and tokens are not for SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, whole texts of any length. An empty table gives no rows; columns of any other name go
    along untouched until the last stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
