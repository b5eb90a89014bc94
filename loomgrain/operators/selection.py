"""Exact selection of the k-th largest value without a global sort."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold_of_top(df: DataFrame, column: str, k: int, cells: int = 4096) -> float:
    """The k-th largest value of a double column (+inf for k = 0, -inf if there are no more than k values).

    Counts the values in equal cells of the range that must hold the answer, then narrows to one cell;
    each pass is one partially aggregated job that returns at most ``cells`` rows. Nulls and NaN don't count.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    if k <= 0:
        return math.inf
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if n <= k:
        return -math.inf
    while low < high:
        width = (high - low) / cells
        if not low < low + width < high or math.isinf(width):
            if math.isinf(width):
                raise ValueError(f"{column} has infinite values")
            # a range of a few doubles: its distinct values are fewer than the cells
            for r in values.where(F.col("x").between(low, high)).groupBy("x").agg(F.count("*").alias("n")).orderBy(F.desc("x")).collect():
                if k <= r["n"]:
                    return r["x"]
                k -= r["n"]
        cell = F.least(F.floor((F.col("x") - low) / width), F.lit(cells - 1))
        rows = values.where(F.col("x").between(low, high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy(F.desc("c")).collect()
        for r in rows:
            if k <= r["n"]:
                low, high = r["a"], r["b"]
                break
            k -= r["n"]
    return low
