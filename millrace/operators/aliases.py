"""Names of things by a table of aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that an alias has at most, unless said otherwise.
WORDS = 4


def words(text):
    """Lower-cased words of a text: letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(1))


def named(rows: DataFrame, text: str, aliases: DataFrame, *, most_words: int = WORDS, out: str = "commodity") -> DataFrame:
    """rows with what the longest alias in their text stands for, of equally long ones the first in it; null if there is none.

    aliases(alias, name), one row an alias: more of them need no new plan. Each distinct text stands under its word n-grams
    of up to `most_words`, and meets the aliases by equality; words are apart by anything that is no word.
    """
    found = words(F.col("t"))
    gram = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i, n), " ").alias("gram")))
    grams = F.flatten(F.array(*(F.when(F.size("w") >= n, gram(n)).otherwise(F.array().cast("array<struct<at:int,gram:string>>")) for n in range(1, most_words + 1))))
    texts = rows.select(F.col(text).alias("t")).where("t IS NOT NULL").distinct().withColumn("w", found)
    known = aliases.select(F.array_join(words(F.col("alias")), " ").alias("gram"), F.col("name").alias("n")).where("gram <> ''").groupBy("gram").agg(F.min("n").alias("n"))
    best = texts.select("t", F.inline(grams)).join(known, "gram").groupBy("t").agg(F.max_by("n", F.struct(F.length("gram"), -F.col("at"))).alias(out))
    return rows.join(best.withColumnRenamed("t", text), text, "left")
