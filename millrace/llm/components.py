"""Connected components of pairs, by DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.llm.common import stored


#: Labels that meet their rows by broadcast; a label of a large component would be a hot key.
BIG = 256


def components(edges: DataFrame) -> DataFrame:
    """From pairs (a, b) of ids: one row (id, label) for each id in a pair; label is the least id that it is linked to.

    Each round, an id takes the least label of its neighbours, then the label of that label, until none changes; the
    number of rounds follows the logarithm of the longest chain. Messages are reduced to a minimum per id before they
    are shuffled, so an id with very many neighbours is no hot spot. Each round's labels are written to the shared
    folder. The labels that most ids begin with (BIG of them) meet their rows by broadcast. Repeated, reversed and self pairs don't matter; pairs with a null are left out.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    big = [r.label for r in labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(BIG).collect()]
    while True:
        heard = (
            both.join(labels, F.col("b") == F.col("id"))
            .groupBy("a")
            .agg(F.min("label").alias("heard"))
        )
        nearer = labels.join(heard, F.col("id") == F.col("a"), "left").select(
            "id", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label")
        )
        roots = nearer.select(F.col("id").alias("label"), F.col("label").alias("root"))
        top = nearer.where(F.col("id").isin(big)).select(F.col("id").alias("label"), F.col("label").alias("root"))
        large = nearer.where(F.col("label").isin(big)).join(F.broadcast(top), "label", "left")
        small = nearer.where(~F.col("label").isin(big)).join(roots, "label", "left")
        jumped = large.unionByName(small).select("id", "old", F.least("label", F.coalesce("root", "label")).alias("label"))
        seen = Observation()
        labels = stored(jumped.observe(seen, F.count_if(F.col("label") != F.col("old")).alias("moved")).select("id", "label"))
        if not seen.get.get("moved"):
            return labels
