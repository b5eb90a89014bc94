"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays."""

from __future__ import annotations

import json
import shutil
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.blocks import Mapped, fill_absent, local_folder, opened, places_in, rows_of, save, shard_of, squeezed
from loomgrain.llm.common import U64, Words, fold, lower_ascii, mix64, slices, utf8
from loomgrain.operators.shared import settled

BEGIN, END = U64(0x0B51_B0A7_5EED_0001), U64(0x0E4D_E4D1_5EED_0002)  # hashes of the two marks no word can be
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BLOB_SCHEMA = "shard int, a binary, b binary, n binary"
STATS = ("tokens", "types", "n1", "n2", "n3", "n4")  # of words, by shard
BASE_ADD = 0.1


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix64(u * U64(0x9E3779B97F4A7C15) ^ (v + U64(0x632BE59BD9B4E019)))


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with END after each text, their predecessors, where each text's tokens begin and end)."""
    words = Words([lower_ascii(utf8(t)) for t in texts])
    h = words.hashes()
    first = words.first + np.arange(len(words.first))
    v = np.full(len(h) + len(texts), END, U64)
    place = np.ones(len(v), bool)
    place[first[1:] - 1] = False
    v[place] = h
    u = np.concatenate([[BEGIN], v[:-1]]).astype(U64)
    u[first[:-1]] = BEGIN
    return v, u, first


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``keys`` in order, with their counts (rows of ``counts``) summed."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    at = np.nonzero(new)[0]
    return [k[at] for k in keys], np.add.reduceat(counts[order], at, axis=0) if len(at) else counts[:0]


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


@dataclass
class Model:
    """Where the arrays are, and the few numbers all of them give.

    ``word-*``: sorted word hashes with token count, distinct predecessors, and followers seen once, twice and
    more often; ``pair-*``: sorted bigram hashes with counts (a byte each; larger ones in a short list).
    """

    folder: str
    shards: int
    hot: np.ndarray
    tokens: int = 0
    types: int = 0
    pair_types: int = 0
    discounts: list[list[float]] = field(default_factory=list)  # of bigrams, of unigrams
    back: float = 1.0  # what unigrams leave to the uniform distribution

    def delete(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def discounts_of(n: np.ndarray) -> list[float]:
    """Discounts for counts of 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    if (n[:4] <= 0).any():
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [float(np.clip(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.01, k + 1)) for k in range(3)]


def frequent_words(docs: DataFrame, share: float = 0.0005) -> np.ndarray:
    """Words that make up ``share`` of a task's tokens and, where they do, of all tokens: their bigrams are dealt out by pair.

    All rows are counted. A word with twice that share of the corpus is always among them, and they are at most
    1 / ``share``. Results don't depend on them.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = (np.zeros(0, U64), np.zeros(0, np.int64)), 0
        for pdf in slices(frames):
            v, _, _ = tokens_of(list(pdf["text"]))
            total += len(v)
            (h,), n = _summed([np.concatenate([held[0], v])], np.concatenate([held[1], np.ones(len(v), np.int64)]))
            held = h, n
            if len(h) > 2_000_000:  # what is rare so far can't be counted on: it is dropped, with an error below half the share
                held = h[n > share / 2 * total], n[n > share / 2 * total]
        often = held[1] >= share / 2 * total
        yield pd.DataFrame({"word": np.append(held[0][often].view(np.int64), 0), "n": np.append(held[1][often], 0), "total": np.append(np.zeros(int(often.sum()), np.int64), total)})

    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, "word long, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    counts = settled(counts)
    total = counts.agg(F.sum("total")).first()[0] or 0
    found = counts.where((F.col("n") > 2) & (F.col("n") >= share * total)).select("word").toPandas()["word"].to_numpy(np.int64).view(U64)
    return np.unique(np.concatenate([found, [BEGIN]]).astype(U64))


def train(docs: DataFrame, shards: int | None = None) -> Model:
    """Count all rows of ``docs(doc_id, text)``; null texts are empty (one END after BEGIN).

    Each task sums the bigrams it reads and sends one compressed block to each bigram shard; a shard merges
    the blocks, writes its sorted array and sends each word shard its sums; word shards merge those and
    write theirs. A word's bigrams share a shard, except frequent words', which are dealt by pair. So no
    task holds more than its share however often one word occurs.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = local_folder(spark, "kneser-ney")
    hot = frequent_words(docs)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        us, vs, pending = [], [], 0

        def blocks() -> Iterator[tuple]:
            (u, v), n = _summed([np.concatenate(us), np.concatenate(vs)], np.ones(pending, np.int64))
            shard = pair_shard(u, pair_hash(u, v), hot, shards)
            order = np.argsort(shard, kind="stable")
            u, v, n = u[order], v[order], n[order]
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in range(shards):
                a, b = ends[s], ends[s + 1]
                if a < b:
                    yield s, squeezed(u[a:b], True), squeezed(v[a:b]), squeezed(n[a:b].astype(np.uint32))

        for pdf in slices(frames):
            v, u, _ = tokens_of(list(pdf["text"]))
            us.append(u)
            vs.append(v)
            pending += len(v)
            if pending > 5_000_000:
                yield from rows_of(blocks())
                us, vs, pending = [], [], 0
        if pending:
            yield from rows_of(blocks())

    def merge_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, pending = None, [], 0

        def merged() -> list:
            (u, v), n = _summed([np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])], np.concatenate([h[2] for h in held]))
            return [(u, v, n)]

        for pdf in frames:
            for s, a, b, n in zip(pdf["shard"], pdf["a"], pdf["b"], pdf["n"], strict=True):
                shard = s
                held.append((opened(a, "<u8", True), opened(b, "<u8"), opened(n, "<u4").astype(np.int64)))
                pending += len(held[-1][0])
                if pending > 6_000_000 and pending > 2 * len(held[0][0]):
                    held = merged()
                    pending = len(held[0][0])
        if not held:
            return
        u, v, n = merged()[0]
        held.clear()
        p = pair_hash(u, v)
        order = np.argsort(p, kind="stable")
        sorted_n = n[order]
        save(folder, f"pair-{shard}-key", p[order])
        save(folder, f"pair-{shard}-n", np.minimum(sorted_n, 255).astype(np.uint8))
        large = np.nonzero(sorted_n >= 255)[0]
        save(folder, f"pair-{shard}-large", np.stack([large, sorted_n[large]]))
        yield pd.DataFrame({"shard": [int(shard)], "a": [b""], "b": [np.array([shard, len(n), *(int((n == k).sum()) for k in (1, 2, 3, 4))]).tobytes()], "n": [b""]})
        zero, one = np.zeros(len(u), np.int64), np.ones(len(u), np.int64)
        as_next = np.stack([n, one, zero, zero, zero], axis=1)
        as_first = np.stack([np.where(u == BEGIN, n, 0), zero, n == 1, n == 2, n > 2], axis=1)
        (w,), sums = _summed([np.concatenate([v, u])], np.concatenate([as_next, as_first]))
        to = shard_of(w, shards)
        ends = np.searchsorted(to, np.arange(shards + 1))
        full = np.nonzero(np.diff(ends))[0]
        yield from rows_of((int(s), squeezed(w[ends[s] : ends[s + 1]], True), b"", squeezed(sums[ends[s] : ends[s + 1]].T.ravel())) for s in full)

    def merge_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, keys, sums, pending, told = None, [], [], 0, b""
        for pdf in frames:
            for s, a, b, n in zip(pdf["shard"], pdf["a"], pdf["b"], pdf["n"], strict=True):
                if b:  # what a bigram shard says of itself
                    told += b
                    continue
                shard = s
                keys.append(opened(a, "<u8", True))
                sums.append(opened(n, "<i8").reshape(5, -1).T)
                pending += len(keys[-1])
                if pending > 2_000_000 and pending > 2 * len(keys[0]):
                    (k,), n = _summed([np.concatenate(keys)], np.concatenate(sums))
                    keys, sums, pending = [k], [n], len(k)
        if told:
            yield pd.DataFrame({"shard": [None], "pairs": [told], **dict.fromkeys(STATS)})
        if not keys:
            return
        (w,), n = _summed([np.concatenate(keys)], np.concatenate(sums))
        save(folder, f"word-{shard}-key", w)
        for i, name in enumerate(("count", "before", "one", "two", "more")):
            save(folder, f"word-{shard}-{name}", _narrow(n[:, i]))
        token = n[:, 1] > 0  # BEGIN follows nothing
        yield pd.DataFrame({"shard": [int(shard)], "pairs": [None], "tokens": [int(n[token, 0].sum())], "types": [int(token.sum())], **{f"n{k}": [int((n[:, 1] == k).sum())] for k in (1, 2, 3, 4)}})

    source = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    pairs = source.mapInPandas(count, BLOB_SCHEMA).repartitionById(shards, F.col("shard"))
    words = pairs.mapInPandas(merge_pairs, BLOB_SCHEMA).repartitionById(shards, F.col("shard"))
    stats = words.mapInPandas(merge_words, "shard int, pairs binary, " + ", ".join(f"{c} long" for c in STATS)).collect()  # two rows a shard at most
    total = {c: sum(r[c] or 0 for r in stats) for c in STATS}
    of_pairs = np.frombuffer(b"".join(r["pairs"] or b"" for r in stats), np.int64).reshape(-1, 6)
    none, pair_stats = np.zeros(0, np.uint8), of_pairs[:, 1:].sum(axis=0)
    fill_absent(folder, shards, {r["shard"] for r in stats} - {None}, ("word-{}-key", np.zeros(0, U64)), *((f"word-{{}}-{name}", none) for name in Arrays.WORD))
    fill_absent(folder, shards, set(of_pairs[:, 0].tolist()), ("pair-{}-key", np.zeros(0, U64)), ("pair-{}-n", none), ("pair-{}-large", np.zeros((2, 0), np.int64)))
    model = Model(folder, shards, hot, total["tokens"], total["types"], int(pair_stats[0]))
    model.discounts = [discounts_of(pair_stats[1:]), discounts_of(np.array([total[f"n{k}"] for k in (1, 2, 3, 4)]))]
    if model.pair_types:
        classes = (total["n1"], total["n2"], model.types - total["n1"] - total["n2"])
        model.back = sum(d * n for d, n in zip(model.discounts[1], classes)) / model.pair_types
    with open(f"{folder}/model.json", "w") as f:
        json.dump({"shards": shards, "hot": [int(h) for h in hot], "tokens": model.tokens, "types": model.types, "pair_types": model.pair_types, "discounts": model.discounts, "back": model.back}, f)
    return model


def pair_shard(u: np.ndarray, p: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
    return shard_of(np.where(hot[at] == u, p, u), shards)


class Arrays:
    """Memory-mapped sorted arrays of a model, opened when first asked for."""

    WORD = ("count", "before", "one", "two", "more")

    def __init__(self, model: Model):
        self.model, self.files = model, Mapped(model.folder)

    def words(self, h: np.ndarray) -> np.ndarray:
        """Five numbers for each of the sorted hashes (0 if unknown)."""
        out = np.zeros((len(h), 5), np.int64)
        ends = np.searchsorted(shard_of(h, self.model.shards), np.arange(self.model.shards + 1))
        for s in np.nonzero(np.diff(ends))[0]:
            a, b = ends[s], ends[s + 1]
            at, there = places_in(self.files[f"word-{s}-key"], h[a:b])
            hit = np.nonzero(there)[0]
            for i, name in enumerate(self.WORD):
                out[a + hit, i] = self.files[f"word-{s}-{name}"][at[hit]]
        return out

    def pairs(self, u: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Counts of bigrams, ``p`` in order."""
        out = np.zeros(len(p), np.int64)
        shard = pair_shard(u, p, self.model.hot, self.model.shards)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s in np.nonzero(np.diff(ends))[0]:
            some = order[ends[s] : ends[s + 1]]
            at, hit = places_in(self.files[f"pair-{s}-key"], p[some])
            n = self.files[f"pair-{s}-n"][at[hit]].astype(np.int64)
            over = np.nonzero(n == 255)[0]
            if len(over):
                large = self.files[f"pair-{s}-large"]
                n[over] = large[1][np.searchsorted(large[0], at[hit][over])]
            out[some[hit]] = n
        return out


def _less(n: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts without their discount."""
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0.0)


class Scorer:
    """log10 probabilities of texts.

    p(w | u) = (c(uw) - D) / c(u) + g(u) p(w), g(u) = (D1 N1(u) + D2 N2(u) + D3 N3+(u)) / c(u), and
    p(w) = (a(w) - D') / A + g' / (V + 1) with a(w) = distinct predecessors and A their sum; an unseen u
    leaves p(w). V + 1 has a place for all unseen words, so p sums to 1 over V words and one unseen.
    """

    def __init__(self, model: Model, arrays: Arrays | None = None):
        self.model, self.arrays = model, arrays or Arrays(model)

    def score(self, batch: list[str]) -> pd.DataFrame:
        m = self.model
        v, u, first = tokens_of(batch)
        vocabulary, where = np.unique(np.concatenate([v, u]), return_inverse=True)
        facts = self.arrays.words(vocabulary)
        unigram = (_less(facts[:, 1], m.discounts[1]) / m.pair_types if m.pair_types else 0.0) + m.back / (m.types + 1)
        total = facts[:, 0]
        gap = np.where(total > 0, facts[:, 2:] @ np.array(m.discounts[0]) / np.maximum(total, 1), 1.0)
        base = np.log10((np.where(facts[:, 1] > 0, total, 0) + BASE_ADD) / (m.tokens + BASE_ADD * (m.types + 1)))
        iv, iu = where[: len(v)], where[len(v) :]
        p, at, back = np.unique(pair_hash(u, v), return_index=True, return_inverse=True)
        count = self.arrays.pairs(u[at], p)
        prob = np.where(total[iu[at]] > 0, _less(count, m.discounts[0]) / np.maximum(total[iu[at]], 1), 0.0) + gap[iu[at]] * unigram[iv[at]]
        sums = lambda x: np.add.reduceat(x, first[:-1]) if len(batch) else x[:0]
        return pd.DataFrame({"n_tokens": np.diff(first), "n_known": sums((facts[iv, 1] > 0).astype(np.int64)), "train_tokens": m.tokens, "base_score": sums(base[iv]), "score": sums(np.log10(prob)[back])})


def score_documents(docs: DataFrame, mod: int = 10, held: int = 0) -> DataFrame:
    """Score every whole text with a model of the rows whose fold is not ``held``.

    Null texts are empty: one END. Without training rows every token is unseen and has probability 1. Null ids count
    as the empty text in the fold; repeated rows count each; texts of any length are read whole; other columns are
    ignored; an empty table gives an empty result. An array that is missing from the model's folder is an error.
    The model stays in the shared folder as long as the result may be read (``Model.delete`` drops it).
    """
    held_out = fold(F.col("doc_id"), mod) == held
    model = train(docs.where(~held_out).select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for pdf in slices(frames):
            scorer = scorer or Scorer(model)
            yield pd.concat([pdf[["doc_id", "held_out"]].reset_index(drop=True), scorer.score(list(pdf["text"]))], axis=1)

    return rows.mapInPandas(run, SCORE_SCHEMA)
