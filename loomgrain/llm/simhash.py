"""SimHash near-duplicates over an inverted index of byte positions with count filtering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.common import give_back, lower_ascii, slices, texts, utf8
from loomgrain.operators.graph import connected_components
from loomgrain.operators.shared import settled, written

SEED = 42


def simhash(text: str, words: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; bit set if set in over half of their hashes."""
    found = lower_ascii(utf8(text)).split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    stop = ends[words - 1 :].tolist()
    start = [0, *(ends[: len(found) - words] + 1).tolist()]
    total = np.zeros(64, np.int64)
    for at in range(0, len(start), 65_536):
        pieces = map(joined.__getitem__, map(slice, start[at : at + 65_536], stop[at : at + 65_536]))
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """``keep`` columns and ``fp`` (the 64 bits as a signed long)."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(frames, "_text"):
            fp = np.array([simhash(t, words) for t in pdf["_text"]], np.uint64).view(np.int64)
            yield pdf.drop(columns="_text").assign(fp=fp)

    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).mapInPandas(run, f"{kinds}, fp long")


#: Sets of four byte positions whose numbers cancel out under exclusive or: 14 sets, any three positions in exactly one of them.
LISTS = tuple(p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0)


def least_matches(bits: int) -> int:
    """Of the lists, how many two fingerprints share at least that differ in so many bits."""
    return min(sum(not set(p) & set(damaged) for p in LISTS) for damaged in combinations(range(8), bits))


def links(distinct: DataFrame, bits: int = 2, crowded: int = 64) -> DataFrame:
    """Edges ``(src, dst)`` among ``distinct(fp)`` whose components are those of all pairs at most ``bits`` apart.

    The inverted index has a posting for each fingerprint and each of 14 sets of four byte positions, under the bytes
    there: a list for a single byte would hold a 256th of all rows, one for four holds those that share 32 bits. Any
    three positions lie in one set, so the lists that a pair shares tell how many positional bytes it shares: 14
    lists are 8 bytes, 7 are 7, 3 are 6, and fewer are at most 5. Two fingerprints 2 bits apart share at least 6
    bytes: pairs are tallied over the lists, those that reach 3 are retained and verified bit by bit.
    Members of a list of more than ``crowded`` are not paired: they meet at midpoints (the fingerprint itself and each
    one-bit change; two at most 2 bits apart share one, and no others do), each linked to the least that has the
    midpoint. A pair whose lists are all short reaches its tally, a pair with a crowded list meets at a midpoint, so no
    link is lost and a list costs at most 65 rows a member, whatever its length.
    """
    if bits != 2:
        raise ValueError("midpoints give distance 2")
    fp = F.col("fp")
    masks = [sum(255 << (8 * p) for p in positions) for positions in LISTS]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("list"), fp.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    postings = distinct.select("fp", keys.alias("p")).select("fp", "p.list", "p.key")
    sizes = postings.groupBy("list", "key").agg(F.count("*").alias("n")).where("n > 1")
    postings = settled(postings.join(sizes, ["list", "key"]))

    few = postings.where(F.col("n") <= crowded)
    a, b = few.select("list", "key", F.col("fp").alias("src")), few.select("list", "key", F.col("fp").alias("dst"))
    tally = a.join(b, ["list", "key"]).where(F.col("src") < F.col("dst")).groupBy("src", "dst").agg(F.count("*").alias("shared"))
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= bits
    pairs = tally.where(F.col("shared") >= least_matches(bits)).where(near)

    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(2**63)).cast("long") for i in range(64)])
    many = postings.where(F.col("n") > crowded).select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda m: fp.bitwiseXOR(m))).alias("mid"))
    least = many.groupBy("mid").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most").select("mid", "least")
    meet = many.join(least, "mid").where(F.col("fp") > F.col("least")).select(F.col("least").alias("src"), F.col("fp").alias("dst"))
    return pairs.select("src", "dst").union(meet).distinct()


def majority(h: np.ndarray) -> int:
    """The SimHash, as a signed long, of 64-bit hashes: a bit is set if it is in over half of them (none: 0)."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        part = np.ascontiguousarray(h[at : at + 65_536]).astype("<u8", copy=False)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<i8")[0])


def bits_apart(similarity: float, deviations: float = 2) -> int:
    """Bits of 64 in which SimHashes of sets of that Jaccard similarity differ: the mean and so many standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * share + deviations * math.sqrt(64 * share * (1 - share)))


#: Sets of three byte positions: two fingerprints that share any three positional bytes meet in one of these 56 lists.
TRIPLES = np.array(list(combinations(range(8), 3)))


def met(postings: pd.DataFrame, bits: int, small: int) -> pd.DataFrame:
    """Pairs ``(src, dst)`` at most ``bits`` apart from whole lists ``(key, fp, weight)``: all pairs of a list of up to ``small``, else each member with the list's weightiest."""
    order = np.lexsort((postings["fp"], -postings["weight"], postings["key"]))
    key, fp = postings["key"].to_numpy()[order], postings["fp"].to_numpy()[order]
    rows = np.arange(len(key))
    start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    length = np.diff(np.append(start, len(key)))
    head, left = np.repeat(start, length), np.repeat(start + length, length) - rows  # a row has left - 1 after it
    length = np.repeat(length, length)
    star = rows[(length > small) & (rows > head)]
    found = [(head[star], star)]
    for d in range(1, small):
        i = rows[(length <= small) & (left > d)]
        found.append((i, i + d))
    a, b = (fp[np.concatenate(side)] for side in zip(*found, strict=True))
    close = np.bitwise_count((a ^ b).view(np.uint64)) <= bits
    pairs = np.unique(np.stack([np.minimum(a, b)[close], np.maximum(a, b)[close]], axis=1), axis=0)
    return pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})


def near(distinct: DataFrame, bits: int, small: int = 8) -> DataFrame:
    """Distinct pairs ``(src, dst)`` of ``distinct(fp, weight)`` that share three positional bytes and are at most ``bits`` apart.

    The inverted index has a posting for each fingerprint and each three byte positions, so meeting in a list is the
    count of shared positional bytes reaching three, which it does for certain up to 5 bits apart. Of a list of more
    than ``small`` each member meets the weightiest only, so a list costs as many pairs as it has members at
    most (half of ``small`` for short ones): who needs every pair must find those that are left another way.
    """
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = len(TRIPLES)

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 2_000):
                fp, weight = (pdf[c].to_numpy()[at : at + 2_000] for c in ("fp", "weight"))
                byte = np.ascontiguousarray(fp).astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).astype(np.int32)
                a, b, c = (byte[:, TRIPLES[:, i]] for i in range(3))
                key = np.arange(n, dtype=np.int32) << 24 | a << 16 | b << 8 | c
                yield pd.DataFrame({"key": key.ravel(), "fp": np.repeat(fp, n), "weight": np.repeat(weight, n)})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            yield met(pd.concat(held, ignore_index=True), bits, small)
        give_back()

    postings = distinct.select("fp", F.col("weight").cast("float").alias("weight")).mapInPandas(post, "key int, fp long, weight float")
    return postings.repartition(tasks, "key").mapInPandas(meet, "src long, dst long").distinct()


def components(marked: DataFrame, bits: int = 2) -> DataFrame:
    """``(fp, component_id)`` for every fingerprint of ``marked(doc_id, fp)``: the smallest id reachable over links.

    Equal fingerprints are one node, so a group of copies of any size is one row here.
    """
    nodes = settled(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    root = connected_components(links(nodes.select("fp"), bits))
    joined = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return joined.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every document.

    Texts without words (null texts too) have fingerprint zero and are linked like any other. A null id
    never names a component unless the component has no other; repeated rows stay repeated. Texts of any length are
    hashed whole; other columns are ignored; an empty table gives an empty result.
    """
    marked = written(fingerprints(texts(docs), ("doc_id",), words), "simhash")
    found = components(marked, bits)
    return marked.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
