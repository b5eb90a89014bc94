"""Near-duplicate groups at a Jaccard similarity: SimHashes that lie close, checked on the shingle sets; for pairs that lie further apart an inverted index of rare shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.llm import simhash
from loomgrain.llm.blocks import Mapped, drop_local, fill_absent, local_folder, opened, places_in, rows_of, save, shard_of, squeezed
from loomgrain.llm.common import U64, Words, fresh, give_back, lower_ascii, mix64, slices, utf8
from loomgrain.operators.graph import connected_components
from loomgrain.operators.shared import dropped, written

SLACK = 1e-9  # for products of a similarity and a count


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the text's distinct word shingles (fewer words: the whole sequence; none: empty)."""
    h = Words([raw]).hashes()
    if not len(h):
        return np.zeros(0, U64)
    n = max(1, len(h) - words + 1)
    sh = np.zeros(n, U64)
    for j in range(min(words, len(h))):
        sh = sh * U64(Words.BASE) + h[j : j + n]
    return np.unique(mix64(sh))


def least_overlap(n, m, similarity: float):
    """Shingles that sets of n and m have in common at least, if they are that similar."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - SLACK)


def prefix_length(n: int, similarity: float) -> int:
    """Of any order of all shingles, two sets of that similarity share one among their first so many."""
    return n - int(np.ceil(similarity * n - SLACK)) + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - SLACK


def leading_bits(texts: DataFrame) -> int:
    """How many bits of a shingle's hash are counted: so many that of 256 shingles one at most meets another by chance, at any size of the corpus."""
    characters = texts.agg(F.sum(F.length("text").cast("double"))).first()[0] or 0.0
    return min(64, 8 + math.ceil(math.log2(2 + characters / 2)))  # a word and its blank: no more shingles than half the characters


def count_shingles(texts: DataFrame, words: int, folder: str, shards: int, bits: int) -> None:
    """For each shard the shingles, by their first ``bits`` in order, that occur twice or more, and how often: over all of ``texts(hash, text)``.

    A task counts a text once however often it reads it, so what copies add is bounded by the tasks.
    Blocks of sorted hashes travel, two to four bytes a shingle; a shard is merged in runs. A shingle that seems to be
    repeated but shares only the bits gets a posting that meets no other; the order of all shingles stays one order.
    """
    cut = U64(64 - bits)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, pending, seen = [], 0, set()

        def blocks() -> Iterator[tuple]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(shard_of(h << cut, shards), np.arange(shards + 1))
            for s in np.nonzero(np.diff(ends))[0]:
                yield int(s), squeezed(h[ends[s] : ends[s + 1]], True), squeezed(n[ends[s] : ends[s + 1]].astype(np.uint32))

        for pdf in slices(frames, "text"):
            for own, text in zip(pdf["hash"].tolist(), pdf["text"], strict=True):
                if own not in seen:
                    seen.add(own)
                    held.append(shingles(lower_ascii(utf8(text)), words) >> cut)
                    pending += len(held[-1])
                if pending > 2_000_000:
                    yield from rows_of(blocks(), columns=("shard", "h", "n"))
                    held, pending = [], 0
        if pending:
            yield from rows_of(blocks(), columns=("shard", "h", "n"))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, hs, ns, pending = None, [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h = np.concatenate(hs)
            order = np.argsort(h, kind="stable")
            h, n = h[order], np.concatenate(ns)[order]
            at = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
            return h[at], np.add.reduceat(n, at)

        for pdf in frames:
            for s, h, n in zip(pdf["shard"], pdf["h"], pdf["n"], strict=True):
                shard = int(s)
                hs.append(opened(h, "<u8", True))
                ns.append(opened(n, "<u4").astype(np.int64))
                pending += len(hs[-1])
                if pending > 2_000_000 and pending > 2 * len(hs[0]):
                    h, n = merged()
                    hs, ns, pending = [h], [n], len(h)
        if pending:
            h, n = merged()
            save(folder, f"shingle-{shard}", h[n > 1])
            save(folder, f"often-{shard}", np.minimum(n[n > 1], 2**32 - 1).astype(np.uint32))
            yield pd.DataFrame({"shard": [shard]})
        give_back()

    blocks = texts.mapInPandas(count, "shard int, h binary, n binary").repartitionById(shards, F.col("shard"))
    done = {r["shard"] for r in blocks.mapInPandas(merge, "shard int").collect()}  # a row for each shard
    fill_absent(folder, shards, done, ("shingle-{}", np.zeros(0, U64)), ("often-{}", np.zeros(0, np.uint32)))


def how_often(arrays: Mapped, shards: int, bits: int, h: np.ndarray) -> np.ndarray:
    """Count of each shingle (1: it occurs nowhere else)."""
    order = np.argsort(h, kind="stable")
    found, first = np.ones(len(h), np.int64), h >> U64(64 - bits)
    ends = np.searchsorted(shard_of(first[order] << U64(64 - bits), shards), np.arange(shards + 1))
    for s in np.nonzero(np.diff(ends))[0]:
        own = order[ends[s] : ends[s + 1]]
        at, there = places_in(arrays[f"shingle-{s}"], first[own])
        found[own[there]] = arrays[f"often-{s}"][at[there]]
    return found


def can_reach(similarity: float, n: Column, p: Column, m: Column, q: Column) -> Column:
    """Count filter: whether sets of n and m, whose first common shingle is at places p and q of their orders, can share enough."""
    enough = F.ceil(F.lit(similarity / (1 + similarity)) * (n + m) - SLACK)
    return (F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - SLACK) & (F.least(n - p, m - q) >= enough)


def meetings(cells: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Distinct pairs ``(x, y)`` of nodes of different components that share a cell and pass the count filter there.

    Members of a cell off the diagonal (``whole`` false) meet those of the other block only.
    """
    cells = cells.sort_values(["cell", "node"], ignore_index=True)
    cell, node, size, place = (cells[c].to_numpy() for c in ("cell", "node", "size", "place"))
    block, whole, group = (cells[c].to_numpy() for c in ("block", "whole", "component"))
    first = np.concatenate([[True], cell[1:] != cell[:-1]])
    start = np.nonzero(first)[0]
    length = np.diff(np.append(start, len(cell)))
    of = np.cumsum(first) - 1
    left = length[of] - (np.arange(len(cell)) - start[of])  # a row meets the rows at distance 1 to left - 1
    live, found, held, d = np.arange(len(cell)), [], 0, 0
    while len(live):
        d += 1
        live = live[left[live] > d]
        i, j = live, live + d
        ok = (group[i] != group[j]) & (whole[i] | (block[i] != block[j])) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - SLACK)
        i, j = i[ok], j[ok]
        ok = np.minimum(size[i] - place[i], size[j] - place[j]) >= least_overlap(size[i], size[j], similarity)
        if ok.any():
            found.append(np.stack([node[i[ok]], node[j[ok]]], axis=1))
            held += len(found[-1])
            if held > 1_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = len(found[0]) // 2
    out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"x": out.min(axis=1), "y": out.max(axis=1)})


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = 256) -> DataFrame:
    """``docs`` with one document, of the least id, for each group of near-duplicates; columns as they were.

    Groups are the components of all pairs of texts whose sets of word shingles have that Jaccard similarity.
    Texts with equal sets are one node. Pairs come from the sets' 64-bit SimHashes first: an index of byte positions,
    a count of shared ones, a bit check (``simhash.near``), then the sets themselves, formed anew from the texts.
    SimHash can miss a pair at that similarity, so those not of one component by then have an exact way.
    A set's shingles are ordered by how often they occur in the corpus, rarest
    first; two similar sets share one of their first few (prefix filtering), and at the first they share both have
    enough left to reach the overlap that the similarity demands (count filtering). So the index loses no pair,
    shingles that occur once take places but no postings, and a common passage stays out of it.
    Each list's members are first held against its most central one (most of whose shingles recur most), which
    joins groups of copies at one pair a member; then all pairs of a list that are not yet of one component meet,
    in blocks of ``block``. All candidates are linked if their sets are that similar.
    Texts without words are one another's copies only if equal. Null ids come last; equal rows are copies. Very long
    texts are taken whole; an empty table stays empty.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    key, own = fresh(docs, "key", "hash")
    rows = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), own: F.xxhash64(text)})
    texts = rows.select(F.col(key).alias("key"), F.col(own).alias("hash"), text.alias("text"))
    folder, shards, bits = local_folder(spark, "shingles"), tasks, leading_bits(texts)
    count_shingles(texts.select("hash", "text"), words, folder, shards, bits)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays, sent = Mapped(folder), set()
        for pdf in slices(frames, "text", 2_000_000):
            sets = [shingles(lower_ascii(utf8(t)), words) for t in pdf["text"]]
            often = np.split(how_often(arrays, shards, bits, np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])
            out = []
            for s, n, k, h, t in zip(sets, often, pdf["key"].tolist(), pdf["hash"].tolist(), pdf["text"], strict=True):
                node = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else h
                order = np.lexsort((s, n))[: prefix_length(len(s), similarity)]
                place = np.nonzero(n[order] > 1)[0]
                once = len(place) > 0 and node not in sent
                if once:
                    sent.add(node)
                out.append((k, h, node, len(s), simhash.majority(s), float(np.log2(n).mean()) if len(s) else 0.0, s[order[place]].view(np.int64) if once else [], place if once else [], t if once else None))
            yield pd.DataFrame(out, columns=["key", "hash", "node", "size", "fp", "central", "cells", "places", "text"])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            yield meetings(pd.concat(held, ignore_index=True), similarity)
        give_back()

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = lru_cache(64)(lambda t: shingles(lower_ascii(utf8(t)), words))
        for pdf in slices(frames, "x_text"):
            yield pdf.loc[[similar(form(a), form(b), similarity) for a, b in zip(pdf["x_text"], pdf["y_text"], strict=True)], ["x", "y"]]

    marked = written(texts.mapInPandas(index, "key long, hash long, node long, size long, fp long, central double, cells array<long>, places array<long>, text string"), "indexed")
    nodes = marked.groupBy("node").agg(F.min(F.struct("key", "hash")).alias("least"))
    first = marked.where("text is not null").select("node", "size", "central", F.explode(F.arrays_zip("cells", "places")).alias("p"))
    lists = first.groupBy(F.col("p.cells").alias("cell"), "node").agg(F.min("size").alias("size"), F.min("central").alias("central"), F.min("p.places").alias("place"))
    heads = lists.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.struct("central", "node", "size", "place")).alias("head")).where("n > 1")
    lists = written(lists.join(heads, "cell"), "lists")
    sources = written(marked.where("text is not null").select("node", "text").join(lists.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs ``(x, y)`` that are similar by their texts."""
        both = pairs.join(sources.toDF("x", "x_text"), "x").join(sources.toDF("y", "y_text"), "y")
        return written(both.mapInPandas(verify, "x long, y long").toDF("src", "dst"), "links")

    def apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
        """The pairs ``(x, y)`` whose nodes aren't of one component yet."""
        both = pairs.join(root.toDF("x", "x_root"), "x", "left").join(root.toDF("y", "y_root"), "y", "left")
        return both.where(F.coalesce("x_root", "x") != F.coalesce("y_root", "y")).select("x", "y")

    alike = written(marked.where("size > 0").groupBy("fp", "node").agg(F.max(F.struct("central", "node", "size")).alias("one")), "simhash")
    first_of = alike.groupBy("fp").agg(F.max("one").alias("first"))  # equal SimHashes are one entry of the index
    close = simhash.near(first_of.select("fp", F.col("first.central").alias("weight")), simhash.bits_apart(similarity))
    close = close.join(first_of.toDF("src", "a"), "src").join(first_of.toDF("dst", "b"), "dst").select("a", "b")
    close = close.union(alike.join(first_of, "fp").where("one.node <> first.node").select("one", "first"))
    close = close.where(F.least("a.size", "b.size") >= F.lit(similarity) * F.greatest("a.size", "b.size") - SLACK)
    near = linked(close.select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")))
    root = connected_components(near)

    to_head = lists.where((F.col("node") != F.col("head.node")) & can_reach(similarity, F.col("size"), F.col("place"), F.col("head.size"), F.col("head.place")))
    rest = linked(apart(to_head.select(F.least("node", "head.node").alias("x"), F.greatest("node", "head.node").alias("y")).distinct(), root))
    edges = near.union(rest)
    root = connected_components(edges)

    members = lists.select("cell", "node", "size", "place", "n").join(root, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = written(members, "members")
    split = members.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("cell")
    blocks = F.ceil(F.col("n") / block)
    dealt = members.join(split, "cell").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    part = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    dealt = dealt.select(part, "node", "size", "place", "block", (F.col("block") == F.col("other")).alias("whole"), "component")
    more = written(dealt.repartition(tasks, "cell").mapInPandas(meet, "x long, y long").distinct(), "pairs")
    steps = [marked, lists, sources, alike, near, rest, members, more]
    if not more.isEmpty():
        steps.append(linked(more))
        root = connected_components(edges.union(steps[-1]))

    grouped = nodes.join(root, "node", "left").groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("least").alias("least"))
    kept = written(grouped.select(F.col("least.key").alias(key), F.col("least.hash").alias(own)), "kept")
    for step in steps:
        dropped(step)
    drop_local(folder)
    return rows.join(kept, [key, own], "left_semi").dropDuplicates([key, own]).select(*docs.columns)
