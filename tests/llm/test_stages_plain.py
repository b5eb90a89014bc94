"""The pipeline's language and quality stages against plain versions, row by row."""

import importlib
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomgrain.llm import importance, langid

SF = "/root/testdata/sf0.001"


def plain_grams(text):
    """Codes of 1- to 3-grams of letters, words between blanks (0), with their counts."""
    low, b = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()], langid._BITS
    x = [0]
    for c in [*low, 0]:
        if c or x[-1]:
            x.append(c)
    n = Counter(c for c in x if c)
    n.update(p << b | q | 1 << 63 for p, q in zip(x, x[1:]))
    n.update((p << 2 * b - 1) % 2**64 ^ q << b ^ r | 1 << 62 for p, q, r in zip(x, x[1:], x[2:]) if q)
    return n if any(x) else Counter()


def ranks(n, size=400):
    return {g: i for i, g in enumerate(sorted(n, key=lambda g: (-n[g], g))[:size])}


def test_language_stage_is_the_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, total = docs.collect(), {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None:
            total.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    profiles = {lang: ranks(n) for lang, n in total.items()}
    want = []
    for r in rows:
        own = ranks(plain_grams(r["text"]))
        if own and profiles:
            away = min(sum(abs(p[g] - i) if g in p else 400 for g, i in own.items()) for p in profiles.values())
            if 1.0 - away / (400 * len(own)) >= 0.2:
                want.append(r["doc_id"])
    got = importlib.import_module("corpus_pipeline").language_stage(spark, docs, SF)
    assert want and sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_language_queries_are_the_plain_ones(spark, messy):
    """Profiles from two of three folds, every document ranked: by counters and dictionaries."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").union(messy.where("doc_id is null or doc_id not in (9, 6)").selectExpr("doc_id + 100000", "text", "lang"))
    rows, total = docs.collect(), {}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and not held(r["doc_id"]):
            total.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    profiles = {lang: ranks(n) for lang, n in total.items()}
    want = Counter()
    for r in rows:
        own, best = ranks(plain_grams(r["text"])), ("und", 0.0)
        if own:
            away, lang = min((sum(abs(p[g] - i) if g in p else 400 for g, i in own.items()), lang) for lang, p in profiles.items())
            best = (lang, round(1.0 - away / (400 * len(own)), 9))
        want[r["doc_id"], held(r["doc_id"]), *best] += 1
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in langid.predict_documents(docs).collect()) == want


def test_resampling_is_the_plain_one(spark, messy, labels):
    """Weights, keys, k and the choice, nulls and ties included, without the module's tasks."""
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    known = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            known[r["doc_id"]] = max(r["quality"], known.get(r["doc_id"], 0))
    sample = {}
    for i, t in rows:
        if i in known:
            sample[i] = min(sample.get(i, t or ""), t or "")
    grams, n = importance.Grams(), importance.BUCKETS
    count = lambda texts: 1 + sum((np.bincount(grams.of(t), minlength=n) for t in texts), np.zeros(n))
    raw, target = count([t or "" for _, t in rows]), count([t for i, t in sample.items() if known[i] == 1])
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    weigh = lambda t: float(ratio[grams.of(t or "")].sum())
    good, bad = ([weigh(t) for i, t in sample.items() if known[i] == y] for y in (1, 0))
    seen = sorted(good + bad)
    cuts = [seen[0], *[(a + b) / 2 for a, b in zip(seen, seen[1:])], seen[-1]]
    cut = min(cuts, key=lambda c: (round(sum(w < c for w in good) / len(good) + sum(w >= c for w in bad) / len(bad), 12), c))
    got = importance.resample(messy, labels).collect()
    assert Counter((r["doc_id"], round(r["log_weight"], 6)) for r in got) == Counter((i, round(weigh(t), 6)) for i, t in rows)
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    k = sum(weigh(t) >= cut - 1e-9 for _, t in rows)
    border = float("-inf") if k >= len(keys) else keys[k - 1] if k else float("inf")
    assert {r["selected"] for r in got} <= {True, False} and all(r["selected"] == (r["gumbel_key"] >= border) for r in got)
    for r in got:  # standard Gumbel noise of the row's own uniform number
        assert np.isfinite(r["gumbel_key"] - r["log_weight"])


def test_passage_stage_is_the_plain_one(spark):
    """Bytes under 100-byte windows that also begin in an earlier document, characters gone only as a whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())
    first = {}
    for i, raw in rows:
        for p in range(len(raw) - 99):
            first.setdefault(raw[p : p + 100], i)
    want = {}
    for i, raw in rows:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if first[raw[p : p + 100]] < i:
                gone[p : p + 100] = b"\1" * 100
        text, at = "", 0
        for c in raw.decode():
            size = len(c.encode())
            text += "" if all(gone[at : at + size]) else c
            at += size
        want[i] = text
    got = importlib.import_module("corpus_pipeline").passage_stage(spark, docs, SF).collect()
    assert {r["doc_id"]: r["text"] or "" for r in got} == want and all(r["n_chars"] == len(r["text"] or "") for r in got if r["text"] is not None)
    assert any(len(want[i]) < len(raw.decode()) for i, raw in rows)


def test_quality_stage_is_the_plain_one(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows, grams, n = docs.collect(), importance.Grams(), importance.BUCKETS
    known = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            known[r["doc_id"]] = max(r["quality"], known.get(r["doc_id"], 0))
    raw, target = np.ones(n), np.ones(n)
    for r in rows:
        for b in grams.of(r["text"] or ""):
            raw[b] += 1
            target[b] += known.get(r["doc_id"]) == 1
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    weight = [float(ratio[grams.of(r["text"] or "")].sum()) for r in rows]
    good, bad = ([w for w, r in zip(weight, rows) if known.get(r["doc_id"]) == y] for y in (1, 0))
    assert good and bad
    seen = sorted(good + bad)
    cuts = [seen[0], *[(a + b) / 2 for a, b in zip(seen, seen[1:])], seen[-1]]
    cut = min(cuts, key=lambda c: (round(sum(w < c for w in good) / len(good) + sum(w >= c for w in bad) / len(bad), 12), c))
    noisy = spark.createDataFrame([(r["doc_id"], w) for r, w in zip(rows, weight)], "doc_id long, w double")
    keyed = [(r["key"], r["doc_id"]) for r in noisy.select("doc_id", (F.col("w") + importance.gumbel(F.coalesce("doc_id", F.lit(0)), F.col("w"))).alias("key")).collect()]
    k = sum(w >= cut for w in weight)
    border = sorted((x for x, _ in keyed), reverse=True)[k - 1]
    got = importlib.import_module("corpus_pipeline").quality_stage(spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for x, i in keyed if x >= border)
