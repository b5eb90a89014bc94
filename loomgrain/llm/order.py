"""Every document beside the one that follows it in id order, with one shuffle of the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.common import U64, texts

NULL_KEY = -(2**63)  # a null id's place in the order


class Blocks:
    """Ranges of (key, text hash). ``cuts`` are keys in order; one that occurs m times heads m blocks, dealt by hash."""

    def __init__(self, cuts: list[int]):
        self.keys, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.times, self.first = times, np.cumsum(times) - times
        self.n = int(times.sum())

    def of(self, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        i = np.maximum(np.searchsorted(self.keys, key, side="right") - 1, 0)
        high = (h.view(U64) ^ U64(1 << 63)) >> U64(32)
        part = ((high * self.times[i].astype(U64)) >> U64(32)).astype(np.int64)
        return (self.first[i] + np.where(key == self.keys[i], part, self.times[i] - 1)).astype(np.int32)


def in_id_order(docs: DataFrame) -> DataFrame:
    """``(block, halo, doc_id, text, times)``, one block to a partition, sorted by (block, halo, id, hash of the text, text).

    Blocks are ranges of ``doc_id`` cut at quantiles, as many as there are shuffle partitions; an id that fills several
    is split among them by the hash of the text, and rows alike in id and text meet in their batch first, as one row
    with ``times``: so a block stays a bounded share whatever ids repeat. The first rows of a block are sent to the
    block before it too, as ``halo`` = 1; the first block's go to the last. So each row's successor, cyclically,
    is itself (if it has copies left) or the next row of its own partition. A null id counts as the least.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs).withColumns({"key": F.coalesce("doc_id", F.lit(NULL_KEY)), "h": F.xxhash64("text")})
    probs = F.array(*[F.lit(i / parts) for i in range(parts)])
    q = rows.agg(F.percentile_approx("key", probs, max(10_000, 20 * parts))).first()[0]
    blocks = Blocks(q or [0])

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            key, h = pdf["key"].to_numpy(np.int64), pdf["h"].to_numpy(np.int64)
            block = blocks.of(key, h)
            order = np.lexsort((h, key, block))
            at = order[np.unique(block[order], return_index=True)[1]]
            yield pd.DataFrame({"block": block[at], "key": key[at], "h": h[at]})

    heads = rows.select("key", "h").mapInPandas(first, "block int, key long, h long").groupBy("block").agg(F.min(F.struct("key", "h")).alias("f"))
    heads = sorted((r["block"], r["f"]["key"], r["f"]["h"]) for r in heads.collect())  # a row a block
    before = {b: heads[i - 1][0] for i, (b, _, _) in enumerate(heads)}
    opens = {b: (k, h) for b, k, h in heads}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            own = pdf.groupby(["key", "text"], sort=False)["h"].transform("size").to_numpy()
            alike = pdf.duplicated(["key", "text"]).to_numpy()
            pdf = pdf.assign(times=own.astype(np.int64), block=blocks.of(pdf["key"].to_numpy(np.int64), pdf["h"].to_numpy(np.int64)), halo=0)[~alike]
            head = np.array([opens[b] == (k, h) for b, k, h in zip(pdf["block"].tolist(), pdf["key"].tolist(), pdf["h"].tolist(), strict=True)], bool)
            yield pdf
            if head.any():
                yield pdf[head].assign(halo=1, times=1, block=[before[b] for b in pdf["block"][head]])

    placed = rows.select("key", "h", "text").mapInPandas(place, "key long, h long, text string, times long, block int, halo int")
    placed = placed.repartitionById(blocks.n, F.col("block")).sortWithinPartitions("block", "halo", "key", "h", "text")
    return placed.select("block", "halo", F.nullif("key", F.lit(NULL_KEY)).alias("doc_id"), "text", "times")
