"""Recall of op7_near_dedup: python -m tests.llm.measure_recall [folder of tables]. Documents whose id is divisible by 50 are
compared with all others; pairs that reach the similarity must be in one group. For a table that one machine can hold."""

import sys
import tempfile

from pyspark.sql import functions as F

from millrace.llm import minhash, near_dedup
from millrace.session import local_session


def main(folder: str) -> None:
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = local_session(8, "recall", **{"spark.driver.memory": "8g", "spark.checkpoint.dir": f"{shared}/checkpoints", "spark.local.dir": f"{shared}/local"})
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = docs.where("text <> ''").select("text")
    idf = near_dedup.inverse_frequencies(texts, docs.count())
    text = {r.doc_id: r.text for r in docs.where("text <> ''").collect()}
    group = {r.doc_id: r.group_id for r in near_dedup.op7_near_dedup(spark, folder).collect()}
    weighed = {i: minhash.weighted(t, idf) for i, t in text.items()}
    total = {i: float(w.sum()) for i, (_, w) in weighed.items()}
    alike = []
    for a in (i for i in text if i % 50 == 0):
        for b in text:
            least, most = sorted((total[a], total[b]))  # what two texts share is the lighter one's weight at most
            if a != b and (text[a] == text[b] or (least >= near_dedup.SIMILARITY * most > 0 and minhash.jaccard(weighed[a], weighed[b]) >= near_dedup.SIMILARITY)):
                alike.append((a, b))
    met = sum(group[a] == group[b] for a, b in alike)
    print(f"{met} of {len(alike)} pairs in one group, {sum(text[a] != text[b] for a, b in alike)} of them of different texts, among {len(text)} documents")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
