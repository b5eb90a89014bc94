"""Quality models see the words, not only their shapes."""

import random

from pyspark.sql import functions as F

from loomgrain.llm import importance


def test_plain_words_of_one_shape_are_told_apart(spark):
    r = random.Random(5)
    good, bad = (["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)] for _ in range(2))
    text = lambda words: " ".join(r.choice(words) for _ in range(40))  # noqa: E731  all lower-case: the shapes are equal
    docs = spark.createDataFrame([(i, text(bad if i % 2 else good)) for i in range(300)], "doc_id long, text string")
    labels = docs.where("doc_id < 150").select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    got = importance.resample(docs, labels).where("doc_id >= 150").collect()
    assert min(x["log_weight"] for x in got if x["doc_id"] % 2 == 0) > max(x["log_weight"] for x in got if x["doc_id"] % 2)
    kept = {x["doc_id"] for x in importance.select_documents(docs, labels).where("doc_id >= 150").collect()}
    assert all(i % 2 == 0 for i in kept) and len(kept) > 60


def test_case_does_not_change_a_word():
    grams = importance.Grams(1000)
    assert set(grams.of("alpha")) & set(grams.of("ALPHA"))
    assert set(grams.of("alpha beta")) != set(grams.of("gamma delta"))
