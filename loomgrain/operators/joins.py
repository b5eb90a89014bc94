"""Joins that aren't plain equality, rewritten so that each runs as an equi-join or a window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backward_asof(left: DataFrame, right: DataFrame, by: list[str], order: str, value: str, tolerance: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """``left`` with ``value`` of the latest ``right`` row of the same ``by`` whose ``order`` is not later.

    One union, one window: rows of both sides are sorted together and the last right row is carried on, so
    no pair is formed however many rows a key has. ``tolerance`` is a condition on ``order`` and ``matched``
    (the right row's order), beyond which the value is null. At equal order the largest value counts.
    ``bucket``, a column of ``order`` that never falls as it rises (a day of a time, say), splits keys that have many
    rows: a key's buckets are sorted in tasks of their own, and what a bucket begins with is carried over from those
    before it, one row a bucket.
    """
    side = F.struct(F.col(order).alias("matched"), F.col(value).alias("v"))
    columns = [c for c in left.columns if c not in (*by, order)]
    part = F.lit(0) if bucket is None else bucket
    r = right.select(*by, order, F.lit(0).alias("_side"), side.alias("_hit"), F.col(value).alias("_v"))
    both = left.withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True).withColumn("_part", part)
    w = Window.partitionBy(*by, "_part").orderBy(F.col(order), F.col("_side"), F.col("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_last", F.last("_hit", ignorenulls=True).over(w)).where("_side = 1")
    if bucket is not None:
        parts = both.groupBy(*by, "_part").agg(F.max("_hit").alias("_hit"))
        earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = parts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_at"), F.last("_hit", ignorenulls=True).over(earlier).alias("_before"))
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_part").eqNullSafe(F.col("_at"))]
        out = out.join(carried.where("_before is not null"), reduce(Column.__and__, same), "left").withColumn("_last", F.coalesce("_last", "_before"))
    out = out.select(*by, order, *columns, F.col("_last.matched").alias("matched"), F.col("_last.v").alias(f"last_{value}"))
    if tolerance is None:
        return out
    return out.withColumn(f"last_{value}", F.when(tolerance, F.col(f"last_{value}"))).withColumn("matched", F.when(tolerance, F.col("matched")))


def longest_prefix(df: DataFrame, path: str, owners: DataFrame, prefix: str, sep: str = "/") -> DataFrame:
    """``df`` with the longest ``prefix`` of ``owners`` that is the path or a folder above it (null: none).

    Each path is taken apart into its own folders, so the join is on equality and costs the path's depth.
    """
    parts = F.split(F.col(path), sep)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    ids = df.select(path).distinct()
    hits = ids.withColumn("_p", F.explode(above)).join(owners.select(F.col(prefix).alias("_p")).distinct(), "_p")
    best = hits.groupBy(path).agg(F.max_by("_p", F.length("_p")).alias("owner"))
    return df.join(best, path, "left")


def first_candidate(df: DataFrame, key: str, candidates: Column, known: DataFrame, name: str) -> DataFrame:
    """``(key, resolved)``: the first of an array of candidates that occurs in ``known``; none: no row."""
    tries = df.select(key, F.posexplode(candidates).alias("_pos", "_try"))
    return tries.join(known.select(F.col(name).alias("_try")).distinct(), "_try").groupBy(key).agg(F.min_by("_try", "_pos").alias("resolved"))


def unique_suffixes(df: DataFrame, path: str, sep: str = "/") -> DataFrame:
    """``(tail, path, n)``: every tail of a path, with how many paths end in it (``path``: the least of them)."""
    parts = F.split(F.col(path), sep)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), sep))
    return df.select(path).distinct().select(path, F.explode(tails).alias("tail")).groupBy("tail").agg(F.min(path).alias(path), F.count("*").alias("n"))
