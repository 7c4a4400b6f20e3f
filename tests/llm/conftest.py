import random

import pytest

WORDS = "the of and grain bid corn bean basis cash field river stone light market elevator delivery price harvest north south".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): prose, copies, near copies, shared lines, odd texts."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(5, 120)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(5)]
    for i in range(10):
        words = rows[i][1].split()
        words[len(words) // 2] = "changed"
        rows.append((200 + i, " ".join(words), "en", "s0"))
    shared = "A line that many of these documents have in common, word for word."
    rows += [(300 + i, f"{prose(rng, 20)}\n  {shared.upper() if i % 2 else shared} \n{prose(rng, 10)}", "en", "s1") for i in range(6)]
    rows += [(400, None, None, None), (401, "", "en", "s2"), (402, "!!! ... ???", "en", None), (403, "ß É ñ 東京 \U0001f600 <|endoftext|>  x\r\n\x0b y", "de", "s2"), (404, "a" * 3000, "en", "s2"), (405, "\n\n\n", "en", "s2")]
    return rows


DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With extra columns whose names the operators use inside, and over several partitions."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, DOCS).repartition(5)
    return df.withColumns({"id": F.lit("x"), "row": F.lit(1), "n": F.lit(2), "t": F.lit("t"), "d": F.lit(0), "label": F.lit(0), "score": F.lit(0)})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
