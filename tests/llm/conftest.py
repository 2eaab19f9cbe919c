import random

import pytest

SYLLABLES = "the an er re tion le ou é sch en ü os ción ñ ing ha st que".split()


def words(r, n):
    return ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    r = random.Random(7)
    passage = " ".join(words(r, 60))
    long = " ".join(words(r, 40_000))
    base = "\n".join(" ".join(words(r, 9)) for _ in range(12))
    near = base.split(" ")
    near[30] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\n \t"), (7, long), (8, "x " + passage + " y"),
        (9, passage), (10, passage + " " + passage), (11, "spam " * 500), (12, "a" * 5000), (None, base), (None, None), (13, "🙂 ▁ é́ \x00 end"),
        (14, "one"), (15, "one"), (16, "\n".join([*base.split("\n")[2:7], "own line", *base.split("\n")[2:7]])), (1, base), (17, "\n\n\n\n\n"), (18, "l1\nl2"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "xx", "k", 3, 4) for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, k string, n_words int, row int").repartition(3).persist()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id < -1")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
