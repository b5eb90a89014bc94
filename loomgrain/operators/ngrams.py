"""Token windows, their buckets, and maximal matches as islands on a diagonal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.operators.shared import settled


def words(text: Column) -> Column:
    """Non-empty white-space separated tokens."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def windows(df: DataFrame, owner: str, tokens: str, size: int) -> DataFrame:
    """``(owner, start, h, g)``: two independent 64-bit hashes of each run of ``size`` tokens; shorter rows give none.

    Each token is hashed once; hashes of 2, 4, 8, ... tokens come from two of half that length, and a window's from the
    two longest that cover it, so a window costs the logarithm of its size.
    """
    out = df.select(owner, F.col(tokens).alias("t")).where(F.size("t") >= size)
    seeds = {"h": F.lit(17), "g": F.lit(71)}

    def of_token(seed: Column) -> Column:
        return F.transform("t", lambda x: F.xxhash64(seed, x))

    def of_two(column: str, seed: Column, apart: int) -> Column:
        """Each place's hash with that ``apart`` places on."""
        n = F.size("h") - apart
        return F.zip_with(F.slice(column, F.lit(1), n), F.slice(column, F.lit(apart + 1), n), lambda x, y: F.xxhash64(seed, x, y))

    def joined(out: DataFrame, apart: int) -> DataFrame:
        return out.select(owner, *[of_two(c, s, apart).alias(c) for c, s in seeds.items()])

    out = out.select(owner, *[of_token(s).alias(c) for c, s in seeds.items()])
    have = 1
    while 2 * have <= size:
        out, have = joined(out, have), 2 * have
    if have < size:
        out = joined(out, size - have)
    return out.select(owner, F.posexplode(F.arrays_zip("h", "g")).alias("start", "w")).select(owner, "start", "w.h", "w.g")


def star_pairs(wins: DataFrame, owner: str, size: int, cap: int | None = None) -> DataFrame:
    """``(a, b, a_start, b_start)``: each window of a bucket with the bucket's first, in (owner, start) order.

    ``wins`` is read twice, so it should be written. Buckets of one window fall away before any pairing and the
    others are few, as a rule; ``cap``, if there is one, keeps a bucket's first members only. The first
    member's position is carried by a partially aggregated minimum, so no bucket is self-joined and a bucket of n
    windows makes n pairs. Windows of one owner pair only if they don't overlap.
    """
    first = settled(wins.groupBy("h", "g").agg(F.min(F.struct(owner, "start")).alias("f"), F.count("*").alias("n")).where("n > 1"))
    rows = wins.join(first, ["h", "g"])
    if cap is not None:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy(owner, "start"))).where(F.col("r") <= cap)
    pairs = rows.select(F.col(f"f.{owner}").alias("a"), F.col(owner).alias("b"), F.col("f.start").alias("a_start"), F.col("start").alias("b_start"))
    return pairs.where((F.col("a") != F.col("b")) | (F.col("b_start") - F.col("a_start") >= size))


def maximal_matches(pairs: DataFrame, size: int) -> DataFrame:
    """``(a, b, a_start, b_start, len)``: runs of consecutive pairs on one diagonal, ``len`` in tokens."""
    keyed = pairs.withColumn("d", F.col("b_start") - F.col("a_start"))
    order = Window.partitionBy("a", "b", "d").orderBy("a_start")
    island = keyed.withColumn("g", F.col("a_start") - F.row_number().over(order))
    return island.groupBy("a", "b", "d", "g").agg(F.min("a_start").alias("a_start"), F.min("b_start").alias("b_start"), (F.count("*") + size - 1).alias("len")).drop("d", "g")


def identity_ratio(a: Column, b: Column) -> Column:
    """Share of places at which two arrays hold the same value, over the shorter one (null if that is empty)."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))
