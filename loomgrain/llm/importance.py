"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.common import fresh, slices
from loomgrain.llm.labelled import labelled_sample
from loomgrain.operators.selection import threshold_of_top
from loomgrain.operators.shared import written

BUCKETS = 10_000
_CLASSES = str.maketrans({**{chr(c): "9" for c in range(48, 58)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}})
_RUNS = re.compile(r"(.)\1+")
_OTHER = re.compile(r"[^\x00-\x7f]")


def shape(word: str) -> str:
    """Character classes of a word with runs shortened: letters by case, digits, other signs as they are."""
    if word.isalpha():  # the common cases, by the same rule
        if word.islower():
            return "a"
        if word[0].isupper() and word[1:].islower():
            return "Aa"
    coarse = _OTHER.sub(lambda m: ("A" if m[0].isupper() else "a") if m[0].isalpha() else m[0], word.translate(_CLASSES))
    return _RUNS.sub(r"\1", coarse)[:12]


class Grams:
    """Hashed unigrams and bigrams of lower-cased words and, beside them, of word shapes; a word that repeats the one before has a shape of its own."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def _codes(self, words: list[str], limit: int = 200_000) -> np.ndarray:
        """A hash of each word, lower-cased, in the high half and one of its shape in the low half."""
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > limit:
                known.clear()
            for w in set(words).difference(known):
                word, form = (zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (w.lower(), shape(w)))
                known[w] = word << 32 | form
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def of(self, text: str) -> np.ndarray:
        """Bucket of every n-gram, repeats included."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64)
        code = self._codes(words)
        word, form = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
        same = np.fromiter(map(str.__eq__, words[1:], words), bool, len(words) - 1)
        form[1:][same] ^= np.uint64(0xA5A5A5A5A5)
        grams = []
        for c in (word ^ np.uint64(0x5BD1E995 << 32), form):  # a word and a shape of equal signs are not one gram
            grams += [c * np.uint64(0xD6E8FEB86659FD93), c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)]
        both = np.concatenate(grams)
        return ((both ^ (both >> np.uint64(32))) % np.uint64(self.buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, by: str | None = None) -> DataFrame:
    """``(y, bucket, n)`` over all of ``docs(text[, y])``: summed per task, then over tasks."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, held = Grams(buckets), {}
        for pdf in slices(frames):
            for y, text in zip(pdf["y"], pdf["text"], strict=True):
                held[y] = held.get(y, 0) + np.bincount(grams.of(text), minlength=buckets)
        for y, n in held.items():
            at = np.nonzero(n)[0]
            yield pd.DataFrame({"y": np.full(len(at), y, np.int32), "bucket": at, "n": n[at]})

    source = docs.where("text is not null").select("text", F.lit(0).alias("y") if by is None else F.col(by).cast("int").alias("y"))
    return source.mapInPandas(count, "y int, bucket long, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n"))


def log_model(counts: dict[int, int], buckets: int) -> np.ndarray:
    """Add-one smoothed log probabilities."""
    n = np.ones(buckets)
    for b, c in counts.items():
        n[b] += c
    return np.log(n / n.sum())


def fit_ratio(docs: DataFrame, sample: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """(log target minus log raw probability of each bucket, cut).

    The raw model counts all of ``docs``; the target model counts the rows of ``sample(text, y)`` with y = 1.
    The cut is the log weight a text must reach to be taken for one of the target's: the value that
    divides the sample's two classes with the least sum of error rates (0 where a class is missing).
    """
    raw = {r["bucket"]: r["n"] for r in bucket_counts(docs, buckets).collect()}  # at most `buckets` rows
    target = {r["bucket"]: r["n"] for r in bucket_counts(sample.where("y = 1"), buckets).collect()}
    if not target:
        return np.zeros(buckets), 0.0
    ratio = log_model(target, buckets) - log_model(raw, buckets)
    w = weigh(sample, ratio, ("y",)).toPandas()
    y, z = w["y"].to_numpy() == 1, w["log_weight"].to_numpy()
    if y.all() or not y.any():
        return ratio, 0.0
    order = np.argsort(z, kind="stable")
    bad = (~y)[order]
    error = np.concatenate([[0], np.cumsum(~bad) / (~bad).sum()]) + np.concatenate([[1], 1 - np.cumsum(bad) / bad.sum()])
    least = np.nonzero(error <= error.min() + 1e-12)[0]
    at = int(least[0])  # of equally good cuts the one that keeps most
    zs = z[order]
    return ratio, float(zs[0] if at == 0 else (zs[at - 1] + zs[min(at, len(zs) - 1)]) / 2)


def weigh(docs: DataFrame, ratio: np.ndarray, keep: tuple[str, ...], name: str = "log_weight") -> DataFrame:
    """``keep`` columns and the log weight: the text's n-grams under the target model against the raw one. Null text: 0."""
    kinds = "".join(f"c{i} {t}, " for i, (_, t) in enumerate(docs.select(*keep).dtypes))
    sent = keep if "text" in keep else (*keep, "text")  # the text goes to the workers once
    own, text = [f"c{i}" for i in range(len(keep))], f"c{sent.index('text')}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(len(ratio))
        for pdf in slices(frames, text):
            yield pdf[own].assign(w=[float(ratio[grams.of(t or "")].sum()) for t in pdf[text]])

    return docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(sent)]).mapInPandas(run, f"{kinds}w double").toDF(*keep, name)


def gumbel(*key: Column, seed: int = 17) -> Column:
    """Standard Gumbel noise that depends on the row alone, so a task that runs again draws the same."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, sample: int = 12_000, buckets: int = BUCKETS, seed: int = 17, rows: Column | None = None) -> DataFrame:
    """``(doc_id, log_weight, gumbel_key, selected)`` for every row.

    Draws k documents without replacement with chances in proportion to their importance weights, as the k
    largest of log weight + Gumbel noise; k is how many documents reach the learned cut. A text without a
    word has weight 1 (log 0), rows with equal keys at the border are all selected, equal rows fare alike. A null id draws
    as id 0; texts of any length are weighed whole; other columns are ignored; an empty table gives an empty result,
    and without labels of one kind every text has weight 1.
    """
    ratio, cut = fit_ratio(docs, labelled_sample(docs, labels, "quality", rows, sample), buckets)
    scored = weigh(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratio, ("doc_id",))
    keyed = written(scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.coalesce("doc_id", F.lit(0)), F.col("log_weight"), seed=seed)), "weights")
    k = keyed.where(F.col("log_weight") >= cut).count()
    return keyed.withColumn("selected", F.col("gumbel_key") >= threshold_of_top(keyed, "gumbel_key", k))


def select_documents(docs: DataFrame, labels: DataFrame, sample: int = 12_000, buckets: int = BUCKETS, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that resampling selects, columns as they were.

    Texts are weighed once, where they are read: the rows are written beside their keys, the border is found among the
    keys, and the choice is a filter on what was written. No text is shuffled.
    """
    ratio, cut = fit_ratio(docs, labelled_sample(docs, labels, "quality", None, sample), buckets)
    weight, key = fresh(docs, "weight", "gumbel_key")
    noise = gumbel(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col(weight), seed=seed)
    weighed = written(weigh(docs, ratio, tuple(docs.columns), weight).withColumn(key, F.col(weight) + noise), "weighed")
    k = weighed.where(F.col(weight) >= cut).count()
    return weighed.where(F.col(key) >= threshold_of_top(weighed, key, k)).select(*docs.columns)
