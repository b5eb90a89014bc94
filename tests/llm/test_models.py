"""Trained operators: held-out quality on small data, edges, and the pipeline's stages."""

import importlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgrain.llm import importance, langid, toxicity
from loomgrain.operators.selection import threshold_of_top

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def known(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


def test_language_held_out(docs):
    got = langid.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.97 and 0 <= r[1] <= r[2] <= 1


def test_language_profile_and_distance_by_hand():
    keys, counts = langid.gram_counts("Ab ab")
    assert counts.sum() == 4 + 4 + 2 + 1 + 4 - 1  # letters; pairs with blanks (3 + 2 shared ends); triples within words
    p = {"x": langid.profile(keys, counts, 300)}
    ranker = langid.Ranker(p, 300)
    assert ranker.predict("ab ab") == ("x", 1.0)
    assert ranker.predict("123 ...") == ("und", 0.0) and ranker.predict(None) == ("und", 0.0)
    assert ranker.predict("zzz")[1] == 0.0


def test_language_edges(messy, nothing):
    got = langid.predict_documents(messy).collect()
    assert len(got) == messy.count()
    for r in got:
        if r["doc_id"] in (3, 4, 5, 11):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.predict_documents(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.predict_documents(messy.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_ranks_held_out(spark):
    docs = spark.createDataFrame([(i, ("plain words of every kind here " * 3) + ("vile idiot scum " if i % 4 == 0 else "kind friend sun ")) for i in range(400)], "doc_id long, text string").withColumn("score", F.lit(9))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert got and all(r["predicted"] == r["toxic"] for r in got)


def test_toxicity_edges(messy, nothing, labels, docs, known):
    got = toxicity.score_documents(messy, labels).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(nothing, labels).count() == 0
    one = {round(r["score"], 9) for r in toxicity.score_documents(messy, labels.limit(0)).collect()}
    assert one == {0.5}
    scored = toxicity.score_documents(docs, known).join(known, "doc_id").groupBy("toxic").agg(F.avg("score")).collect()
    by = dict(tuple(r) for r in scored)
    assert by[1] > by[0]


def test_toxicity_grams_are_characters_of_any_script():
    text = "Ab日本é!"
    low = "ab日本é "
    for n, (at, h) in zip(toxicity.LENGTHS, toxicity.gram_hashes([text, "zz ab日本"], 20)):
        gap = " " * max(toxicity.LENGTHS)
        whole = gap + low + gap + "zz ab日本" + gap + gap
        seen = {}
        for i in range(len(h)):
            assert seen.setdefault(whole[i : i + n], h[i]) == h[i]
        assert len(set(seen.values())) == len(seen) and at.tolist() == [0, 12, 25]


def test_toxicity_against_a_plain_version(spark):
    """Counts, log-count ratios and scores of a small sample, by sets and dictionaries; the coefficients minimise the same loss."""
    import numpy as np

    texts = [("good calm day " if i % 3 else "vile foul rot ") + f"word{i % 7} of note{i % 5}" for i in range(60)]
    sample = spark.createDataFrame([(i, t, int(i % 3 == 0)) for i, t in enumerate(texts)], "doc_id long, text string, y int")
    y = np.array([int(i % 3 == 0) for i in range(60)])
    model = toxicity.fit(sample, bits=18)
    held = [{int(x) for at, h in toxicity.gram_hashes([t], 18) for x in h[at[0] : at[1]]} for t in texts]
    n = [len(y) - y.sum(), y.sum()]
    counts = np.zeros((2, 1 << 18))
    for label, grams in zip(y, held):
        counts[label, list(grams)] += 1
    p, q = (counts[1] + 1) / (n[1] + 2), (counts[0] + 1) / (n[0] + 2)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    chosen = np.nonzero(model.slot >= 0)[0]
    mean = counts.sum(axis=0) / 60
    gap = np.abs(counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / n[0] + 1 / n[1]))
    assert set(chosen.tolist()) == set(np.nonzero((gap > 3) & (counts.sum(axis=0) >= 3))[0].tolist()) and len(chosen) < 3000
    x = np.array([[ratio[c] if c in grams else 0.0 for c in chosen] for grams in held])
    coefficient = model.weight / ratio[chosen]
    error = np.where(y > 0, 2.0, 1.0) * (1 / (1 + np.exp(-(x @ coefficient + model.bias))) - y) / 60
    assert np.abs(x.T @ error + 0.05 * coefficient / 60).max() < 2e-3 and abs(error.sum()) < 2e-3  # the loss is flat there
    rows, what = toxicity.features_of(texts, model.slot, 18)
    assert {(int(a), int(chosen[b])) for a, b in zip(rows, what)} == {(i, c) for i, grams in enumerate(held) for c in grams & set(chosen.tolist())}


def test_threshold_is_the_kth_value(spark):
    values = [0.5, 0.5, 1.0, -3.0, 1e300, -1e300, 2.5, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted((v for v in values if v is not None and v == v), reverse=True)
    for k in range(1, len(ordered)):
        assert threshold_of_top(df, "x", k, cells=3) == ordered[k - 1]
    assert threshold_of_top(df, "x", 0) == float("inf") and threshold_of_top(df, "x", 99) == float("-inf")


def test_importance_separates_quality(docs, known):
    got = importance.resample(docs, known).join(known, "doc_id").groupBy("quality", "selected").count().collect()
    n = {(r["quality"], r["selected"]): r["count"] for r in got}
    assert n[1, True] > 0.97 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) < 0.1 * (n[0, False] + n.get((0, True), 0))


def test_importance_weights_by_hand(spark):
    import numpy as np

    docs = spark.createDataFrame([(1, "One two"), (2, "9 9 9"), (3, None)], "doc_id long, text string")
    sample = docs.where("doc_id < 3").withColumn("y", (F.col("doc_id") == 1).cast("int"))
    ratio, _ = importance.fit_ratio(docs, sample, 50)
    grams = importance.Grams(50)
    target, raw = np.ones(50), np.ones(50)
    np.add.at(target, grams.of("One two"), 1)
    for t in ("One two", "9 9 9"):
        np.add.at(raw, grams.of(t), 1)
    want = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(ratio, want)
    got = {r["doc_id"]: r["w"] for r in importance.weigh(docs, ratio, ("doc_id",), "w").collect()}
    assert got[1] == pytest.approx(want[grams.of("One two")].sum()) and got[3] == 0.0


def test_importance_edges(messy, nothing, labels):
    assert importance.resample(messy, labels).count() == messy.count()
    assert importance.resample(nothing, labels).count() == 0
    assert importance.select_documents(messy, labels).columns == messy.columns


def test_pipeline_stages(spark, docs):
    pipeline = importlib.import_module("corpus_pipeline")
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, now, SF).cache()
        assert out.columns == docs.columns
        assert out.join(now.select("doc_id"), "doc_id", "left_anti").isEmpty() and out.count() <= now.count(), name
        now = out
    packed = pipeline.STAGES[-1][1](spark, now, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in now.select("doc_id").collect()}


def test_pipeline_stage_edges(spark, messy, nothing):
    pipeline = importlib.import_module("corpus_pipeline")
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
    got = Counter(r["doc_id"] for r in pipeline.language_stage(spark, messy, SF).collect())
    assert got[3] == got[4] == got[5] == got[11] == 0 and got[0] == 1
    assert pipeline.passage_stage(spark, messy, SF).columns == messy.columns
