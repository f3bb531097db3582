import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string"
LINE = "this line is shared by many documents"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'é' if r.random() < 0.1 else ''}" for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty and long texts, repeated rows, copies, near copies, shared lines and passages."""
    base, passage = prose(1, 300), prose(2, 30)
    words = base.split()
    rows = [
        (None, "a text without an id " * 20, "en", "s"), (1, None, "en", "s"), (2, "", None, "s"), (3, " \t\n ", "en", None),
        (4, "one", "en", "s"), (5, "one", "en", "s"), (6, "One", "en", "s"), (7, "a b c d", "fr", "s"),
        (10, base, "en", "s"), (11, base, "en", "s"), (12, base + " tail", "en", "s"), (12, base + " tail", "en", "s"),
        (13, " ".join(words[:150] + ["other"] + words[151:]), "en", "t"), (14, prose(3, 40) + " " + passage + " " + prose(4, 40), "en", "t"),
        (15, passage + "\n" + prose(5, 60), "fr", "t"), (16, prose(6, 30_000, 9000), "en", "s"), (17, "x" * 300, "en", "s"),
        (18, "..." * 40, "en", "s"), (19, "same words here " * 60, "en", "s"),
    ]
    rows += [(20 + i, f"{prose(30 + i, 8)}\n  {LINE.upper() if i % 2 else LINE}\t\n{prose(60 + i, 8)}\n\n{LINE}", "en", "s") for i in range(5)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(messy):
    """The same rows with columns named like those the operators use or return."""
    from pyspark.sql import functions as F

    names = ["row", "n", "n_words", "kept", "N_LINES", "shard", "slot", "tokens", "weight", "spans", "score", "_0", "_1", "key", "a", "raw"]
    return messy.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])
