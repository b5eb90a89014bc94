"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.common import U64, fold, mix64, slices
from loomgrain.llm.labelled import labelled_sample

SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
LENGTHS = (2, 4, 5, 6)  # characters
_GAP = " " * max(LENGTHS)
#: ASCII letters lower-cased, digits as they are, everything else of ASCII a blank.
_CLEAN = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(128)], np.uint32)
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Model:
    """``slot`` maps an n-gram hash to a feature (or -1); ``weight`` is its log-count ratio times its coefficient."""

    bits: int
    slot: np.ndarray
    weight: np.ndarray
    bias: float


def gram_hashes(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (starts of the texts among the joined characters, hash of the n-gram at each character).

    Characters are code points, lower-cased; beyond ASCII they stand as they are, in any script.
    """
    low = [t.lower() for t in texts]
    at = np.cumsum([0] + [len(t) + len(_GAP) for t in low])
    c = np.frombuffer((_GAP + "".join(t + _GAP for t in low) + _GAP).encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(c < 128, _CLEAN[np.minimum(c, 127)], c).astype(U64)
    size = len(c) - 2 * len(_GAP) + len(_GAP)
    gram = np.zeros(size, U64)
    for n in range(max(LENGTHS)):
        gram = gram * U64(_BASE) + c[n : n + size]
        if n + 1 in LENGTHS:
            yield at, ((mix64(gram + U64(n))) >> U64(64 - bits)).astype(np.int32)


def document_counts(sample: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """How many documents of each class hold each hashed n-gram, and how many documents there are."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = np.zeros((2, 1 << bits), np.int32), [0, 0]
        for pdf in slices(frames, limit=1_000_000):
            y = (pdf["y"].to_numpy() > 0).astype(int)
            total = [total[0] + int((y == 0).sum()), total[1] + int(y.sum())]
            grams = list(gram_hashes(list(pdf["text"]), bits))
            for i, label in enumerate(y):
                found = np.unique(np.concatenate([h[at[i] : at[i + 1]] for at, h in grams]))
                held[label, found] += 1
        if sum(total):
            for label in (0, 1):
                yield pd.DataFrame({"y": [label], "n": [total[label]], "held": [held[label].tobytes()]})

    counts, n = np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
    for row in sample.mapInPandas(count, "y int, n long, held binary").collect():  # two rows for each of a fixed number of parts
        counts[row["y"]] += np.frombuffer(row["held"], np.int32)
        n[row["y"]] += row["n"]
    return counts, n


def features_of(texts: list[str], slot: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, feature) pairs."""
    who, what = [], []
    at = None
    for at, h in gram_hashes(texts, bits):
        f = slot[h]
        hit = np.nonzero(f >= 0)[0]
        who.append(np.searchsorted(at, hit, side="right") - 1)
        what.append(f[hit].astype(np.int64))
    if at is None or not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = int(slot.max()) + 1 if len(slot) else 1
    pairs = np.unique(np.concatenate(who) * max(width, 1) + np.concatenate(what))
    return pairs // max(width, 1), pairs % max(width, 1)


def fit(sample: DataFrame, bits: int = 20, features: int = 3000, ridge: float = 0.05, rounds: int = 300) -> Model:
    """Fit on ``sample(text, y)``. With one class only, every score is the smoothed share of label 1."""
    counts, n = document_counts(sample, bits)
    prior = math.log((n[1] + 1) / (n[0] + 1))
    slot = np.full(1 << bits, -1, np.int16)
    if not n.all():
        return Model(bits, slot, np.zeros(0), prior)
    p, q = (counts[1] + 1.0) / (n[1] + 2.0), (counts[0] + 1.0) / (n[0] + 2.0)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    mean = counts.sum(axis=0) / n.sum()
    gap = np.abs(counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / n[0] + 1 / n[1]))
    gap[counts.sum(axis=0) < 3] = 0
    chosen = np.argsort(-gap, kind="stable")[:features]
    chosen = np.sort(chosen[gap[chosen] > 3.0])
    slot[chosen] = np.arange(len(chosen))
    r = ratio[chosen]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(frames):
            who, what = features_of(list(pdf["text"]), slot, bits)
            ends = np.searchsorted(who, np.arange(len(pdf) + 1))
            yield pd.DataFrame({"y": (pdf["y"].to_numpy() > 0).astype(np.int32), "f": [what[a:b].astype(np.int16).tobytes() for a, b in zip(ends, ends[1:])]})

    got = sample.mapInPandas(rows, "y int, f binary").collect()  # a row of feature numbers for each of the sample's rows
    y = np.array([g["y"] for g in got], float)
    cols = [np.frombuffer(g["f"], np.int16) for g in got]
    who = np.repeat(np.arange(len(got)), [len(c) for c in cols])
    what = np.concatenate(cols).astype(np.int64) if cols else np.zeros(0, np.int64)
    return Model(bits, slot, *_logistic(who, what, y, r, prior, ridge, rounds))


def _logistic(who: np.ndarray, what: np.ndarray, y: np.ndarray, r: np.ndarray, prior: float, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on the scaled features by accelerated gradient steps."""
    scale, n, k = r[what], len(y), len(r)
    cost = np.where(y > 0, 2.0, 1.0)  # a miss costs two false alarms

    def forward(w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(who, scale * w[what], n)

    def back(e: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(what, scale * e[who], k), e.sum()

    v, vb, top = np.ones(k), 1.0, 1.0
    for _ in range(12):  # the largest curvature, by power iteration
        v, vb = back(forward(v, vb))
        top = math.sqrt(v @ v + vb * vb)
        v, vb = v / top, vb / top
    step = 1.0 / (0.25 * 2.2 * top / n + ridge / n)
    w, b, t = np.zeros(k), prior, 1.0
    v, vb = w, b
    for _ in range(rounds):
        gw, gb = back(cost * (1 / (1 + np.exp(-np.clip(forward(v, vb), -50, 50))) - y) / n)
        nw, nb = v - step * (gw + ridge * v / n), vb - step * gb
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return r * w, float(b)


def score_documents(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, threshold: float = 0.7, sample: int = 16_000) -> DataFrame:
    """Score every whole text; learn from at most ``sample`` labelled rows whose fold is not ``held``.

    Null texts are empty and get the bias's score. Labels, language, source and id are never inputs. Null ids count as
    the empty text in the fold and learn nothing; repeated rows score alike; texts of any length are read whole; other
    columns are ignored; an empty table gives an empty result, and without labels of both classes every score is
    the smoothed share of label 1.
    """
    model = fit(labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), mod) != held, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), mod) == held).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(frames, limit=1_000_000):
            who, what = features_of(list(pdf["text"]), model.slot, model.bits)
            z = model.bias + np.bincount(who, model.weight[what] if len(what) else None, len(pdf))
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pdf[["doc_id", "held_out"]].assign(score=score, predicted=(score >= threshold).astype(np.int32))

    return rows.mapInPandas(run, SCORE_SCHEMA)
