import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, key string, score int, node int, block int, h int, bucket int, y int, t int, c0 int, rank int, weight int, gumbel_key int, language int, _score int, _key int, _hash int, size int, hash int, language_ int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "re", "ti", "on", "the", "st", "ou", "er", "in", "sh"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text or ""), "x", "k", *range(1, 19))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empties, ties, repeated rows, a very long text, other scripts; extra columns with clashing names."""
    base = prose(1, 400)
    rows = [
        row(0, base), row(1, base), row(2, base.replace("the", "then", 2)), row(3, None), row(4, ""), row(5, "   \n\t "), row(6, prose(2, 30)), row(6, prose(2, 30)), row(6, prose(3, 40)),
        row(None, prose(4, 60)), row(None, None), row(7, "a"), row(8, "日本語 テキスト 😀 ▁ x"), row(9, prose(5, 30_000)), row(10, prose(6, 200) + " " + base[300:900]), row(11, "1234 !!! ---", None),
        row(12, "that " * 300), row(13, "that " * 300 + "end"), row(-5, prose(7, 80), None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(13)] + [(0, None, None), (None, 1, 1), (0, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
