"""Best-fit packing: few-document length patterns fitted to the length histogram by non-negative least squares."""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.llm.common import slices, texts
from loomgrain.operators.shared import written

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
Plan = list[tuple[tuple[int, ...], int]]  # (lengths of a sequence's pieces, how many such sequences)


def patterns_of(lengths: np.ndarray, size: int, parts: int = 3, limit: int = 150_000) -> np.ndarray:
    """Rows of at most ``parts`` lengths (0: none), each row filling a sequence to the least slack that gives some.

    Exact fits come first; slack is only allowed where the lengths are too few for exact fits to abound. At most
    ``limit`` patterns are kept, those of least slack and least first length: it bounds the driver's fit, and pieces that
    no pattern takes go by best fit, so the cost is a few sequences, never a piece.
    """
    present = np.zeros(size + 1, bool)
    present[lengths] = True
    ls = np.sort(lengths).astype(np.int64)
    out: list[np.ndarray] = []
    found = 0
    for slack in range(0, max(1, size // 16)):
        total = size - slack
        if total <= size and present[total]:
            out.append(np.array([[total, 0, 0]]))
        if parts >= 2:
            b = total - ls
            ok = (b >= ls) & (b > 0)
            ok[ok] = present[b[ok]]
            out.append(np.stack([ls[ok], b[ok], np.zeros(ok.sum(), np.int64)], axis=1))
        if parts >= 3:
            for a in ls[ls * 3 <= total]:
                mid = ls[(ls >= a) & (2 * ls <= total - a)]
                c = total - a - mid
                ok = present[c]
                if ok.any():
                    out.append(np.stack([np.full(ok.sum(), a), mid[ok], c[ok]], axis=1))
        found = sum(len(o) for o in out)
        if found >= 4 * len(ls) or found > limit:
            break
    return np.concatenate(out)[:limit] if found else np.zeros((0, 3), np.int64)


def nonnegative_fit(patterns: np.ndarray, target: np.ndarray, rounds: int = 40, batch: int = 64) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths nearest to ``target`` (a count per length).

    Active-set least squares: each round lets in patterns of the steepest descent that share no length,
    solves for those let in, and steps back to the border where a count would turn negative.
    """
    x = np.zeros(len(patterns))
    if not len(patterns):
        return x
    size = len(target)
    weight = np.sqrt(np.linspace(0.3, 1.0, size))  # long pieces are the hardest to place later
    active = np.zeros(0, np.int64)

    def used(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        got = np.zeros(size)
        for j in range(patterns.shape[1]):
            got += np.bincount(patterns[at, j], counts, size)
        got[0] = 0
        return got

    for _ in range(rounds):
        r = (target - used(active, x[active])) * weight * weight
        r[0] = 0
        gain = r[patterns].sum(axis=1)
        gain[active] = -1
        taken, fresh = np.zeros(size, bool), []
        for p in np.argsort(-gain)[: batch * 20]:
            if gain[p] <= 0.5 or len(fresh) == batch:
                break
            ls = patterns[p][patterns[p] > 0]
            if not taken[ls].any():
                taken[ls] = True
                fresh.append(p)
        if not fresh:
            break
        active = np.concatenate([active, np.array(fresh)])
        while len(active):
            a = np.zeros((size, len(active)))
            for j in range(patterns.shape[1]):
                np.add.at(a, (patterns[active, j], np.arange(len(active))), 1.0)
            a[0] = 0
            a *= weight[:, None]
            z = np.linalg.solve(a.T @ a + 1e-6 * np.eye(len(active)), a.T @ (target * weight))
            if (z > 0).all():
                x[active] = z
                break
            now = x[active]
            bad = z <= 0
            ratio = now[bad] / np.maximum(now[bad] - z[bad], 1e-12)
            step = ratio.min() if len(ratio) else 1.0
            moved = now + step * (z - now)
            gone = bad & (moved <= 1e-9)
            if not gone.any():
                gone = bad
            x[active] = np.where(gone, 0, moved)
            active = active[~gone]
    return x


def best_fit(counts: np.ndarray, size: int, open_bins: Plan) -> Plan:
    """Place ``counts[length]`` pieces, longest first, each where it leaves the least room; equal sequences move as one."""
    by_gap: dict[int, Counter] = {}
    for pattern, n in open_bins:
        by_gap.setdefault(size - sum(pattern), Counter())[pattern] += n
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            gap = next((g for g in range(length, size) if by_gap.get(g)), None)
            if gap is None:
                # open sequences of this length alone, as many copies in each as fit
                each = size // length
                whole, rest = divmod(left, each)
                for copies, n in ((each, whole), (rest, 1)):
                    if copies and n:
                        by_gap.setdefault(size - copies * length, Counter())[(length,) * copies] += n
                break
            pattern, n = next(iter(by_gap[gap].items()))
            copies = min(gap // length, left)
            moved = min(n, left // copies)
            by_gap[gap][pattern] -= moved
            if not by_gap[gap][pattern]:
                del by_gap[gap][pattern]
            by_gap.setdefault(gap - copies * length, Counter())[pattern + (length,) * copies] += moved
            left -= moved * copies
    return [(p, n) for g in sorted(by_gap) for p, n in sorted(by_gap[g].items())]


def plan_sequences(histogram: dict[int, int], size: int, parts: int = 3, passes: int = 3) -> Plan:
    """Patterns and how often each is used; together they hold exactly the histogram's pieces.

    Patterns are fitted, their counts rounded down, what is left is fitted again, and the last
    residual goes by best fit into the room left and into new sequences.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    fixed: Counter = Counter()
    if left[size]:
        fixed[(size,)] += int(left[size])
        left[size] = 0
    for _ in range(passes):
        present = np.nonzero(left)[0]
        patterns = patterns_of(present, size, parts)
        x = np.floor(nonnegative_fit(patterns, left.astype(float)) + 1e-6).astype(np.int64)
        placed = 0
        for p in np.argsort(-x, kind="stable"):
            if x[p] < 1:
                break
            ls = patterns[p][patterns[p] > 0]
            kinds, times = np.unique(ls, return_counts=True)
            n = int(min(x[p], (left[kinds] // times).min()))
            if n:
                left[kinds] -= n * times
                fixed[tuple(sorted(map(int, ls), reverse=True))] += n
                placed += n
        if not placed:
            break
    return best_fit(left, size, list(fixed.items()))


def slots_of(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset): where the pieces of each length go, by rank."""
    used: Counter = Counter()
    out, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


_ENCODERS: dict[str, tiktoken.Encoding] = {}


def byte_signs() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` JSON file, once per process, with its added tokens: their strings in a text are those tokens.

    Gives the ids that library gives, at a quarter of its time. A file that means anything else raises.
    """
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"] or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = all(not t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        in_order = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        if file["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or not plain or not in_order:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        signs = byte_signs()
        ranks = {bytes(signs[c] for c in token): i for token, i in model["vocab"].items()}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in file["added_tokens"]})
    return _ENCODERS[path]


def pieces_of(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """One row for each piece of each document: its ids, then ``end_id``; all but the first piece have ``size`` ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for pdf in slices(frames):
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array([*enc.encode(text, allowed_special="all"), end_id], "<u4")
                at, to = 0, len(ids) % size or size
                piece = 0
                while at < len(ids):
                    rows.append((doc, piece, at, to - at, zlib.crc32(ids[at:to].tobytes())))
                    at, to, piece = to, to + size, piece + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return texts(docs).mapInPandas(run, PIECE_SCHEMA)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 1024, end_id: int = 2, parts: int = 3) -> DataFrame:
    """Pack all documents (null text: empty, so only ``end_id``) into sequences of at most ``size`` tokens.

    Texts are tokenized once; what is kept, ranked and joined are the pieces (44 bytes each). The driver sees
    the histogram of at most ``size`` lengths and returns the plan's slots; each piece's rank among those of
    its length, counted in buckets so that no length gathers in one task, gives its slot. Ids are those of the
    ``tokenizers`` JSON file, whose added tokens' strings become those tokens. Repeated and null ids are documents of
    their own; only texts of over ``size`` tokens are cut; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = pieces_of(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), size, end_id)
    pieces = written(found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")), "pieces")
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(slots_of(plan_sequences(histogram, size, parts)), "s_length long, low long, high long, first_sequence long, offset long")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(order) - 1).join(before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("r") + F.col("before"))
    placed = ranked.join(slots, (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
