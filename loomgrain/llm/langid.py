"""Language identification with rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.llm.common import fold, slices

PREDICTION_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
UNKNOWN = "und"
_BITS = 21  # a code point
_GRAMS = 3


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every run of anything but letters is one 0; 0 at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letter_table()[points]
    kept = np.where(is_letter, points, 0)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return np.concatenate([[0], kept[keep], [0]] if len(points) and is_letter[-1] else [[0], kept[keep]]).astype(np.uint64)


_TABLE: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of the text's words with a blank at each end, as 64-bit codes, and their counts."""
    x = letters_of(text)
    if len(x) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    one = x[x > 0]
    two = ((x[:-1] << np.uint64(_BITS)) | x[1:]) | np.uint64(1 << 63)
    inner = x[1:-1] > 0  # a blank within a 3-gram would join two words
    three = ((x[:-2] << np.uint64(2 * _BITS - 1)) ^ (x[1:-1] << np.uint64(_BITS)) ^ x[2:])[inner] | np.uint64(1 << 62)
    keys = np.sort(np.concatenate([one, two, three]))
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.nonzero(new)[0]
    return keys[at], np.diff(np.append(at, len(keys)))


def profile(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams in rank order, ties by code."""
    return keys[np.lexsort((keys, -counts))[:size]]


def learn_profiles(labelled: DataFrame, size: int = 400) -> dict[str, np.ndarray]:
    """Language profiles from all rows of ``labelled(text, lang)``; rows with a null in either are passed over.

    Counts are summed per task, then over tasks; the most frequent are chosen within salted parts of each
    language first, so the driver gets at most 16 * ``size`` n-grams of a language.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        pending = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        for pdf in slices(frames):
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                keys, counts = gram_counts(text)
                held.setdefault(lang, []).append((keys, counts))
                pending += len(keys)
            if pending > 2_000_000:
                held = {lang: [merged(parts)] for lang, parts in held.items()}
                pending = 0
        for lang, parts in held.items():
            keys, counts = merged(parts)
            for lo in range(0, len(keys), 50_000):
                yield pd.DataFrame({"lang": lang, "gram": keys[lo : lo + 50_000].view(np.int64), "n": counts[lo : lo + 50_000]})

    counts = labelled.where("text is not null and lang is not null").select("text", "lang").mapInPandas(count, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(16)))
    best = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "gram")
    rows = total.withColumn("r", F.row_number().over(best)).where(F.col("r") <= size).select("lang", "gram", "n").toPandas()
    return {lang: profile(g["gram"].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy(), size) for lang, g in rows.groupby("lang", sort=True)}


class Ranker:
    """Out-of-place distance of a text to each profile; the nearest wins, ties to the first name."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.size, self.names = size, sorted(profiles)
        self.keys = np.unique(np.concatenate([profiles[n] for n in self.names])) if self.names else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.names), len(self.keys) + 1), -1, np.int64)
        for i, n in enumerate(self.names):
            self.rank[i, np.searchsorted(self.keys, profiles[n])] = np.arange(len(profiles[n]))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = gram_counts(text or "")
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0
        own = profile(keys, counts, self.size)
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        theirs = self.rank[:, at]
        away = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(away.argmin())
        return self.names[best], float(1.0 - away[best] / (self.size * len(own)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 400, keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns with the language and its score under ``names`` (score 1: the profile's very order, 0: nothing in common).

    Only the text is looked at. A null text, or one without a letter, is ``und`` with score 0; so is every
    text if no profile was learned.
    """
    kinds = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.select(*keep).dtypes))
    ours = "lang_pred string, score double"
    sent = keep if "text" in keep else (*keep, "text")  # the text goes to the workers once
    own, text = [f"c{i}" for i in range(len(keep))], f"c{sent.index('text')}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(profiles, size)
        for pdf in slices(frames, text):
            got = [ranker.predict(t) for t in pdf[text]]
            yield pdf[own].assign(lang_pred=[g[0] for g in got], score=[g[1] for g in got])

    return docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(sent)]).mapInPandas(run, f"{kinds}, {ours}" if kinds else ours).toDF(*keep, *names)


def predict_documents(docs: DataFrame, size: int = 400, mod: int = 3, held: int = 1) -> DataFrame:
    """Learn from the rows whose fold is not ``held`` and predict every row; extra columns are ignored."""
    held_out = fold(F.col("doc_id"), mod) == held
    profiles = learn_profiles(docs.where(~held_out).select("text", "lang"), size)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return identify(rows, profiles, size, ("doc_id", "held_out"))
