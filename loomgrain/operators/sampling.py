"""Systematic sampling without a single-partition ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.operators.shared import settled


def every_nth(df: DataFrame, order: str, wanted: int) -> DataFrame:
    """Every ``max(1, floor(n / wanted))``-th row in ``order``, ``wanted`` of them at most.

    Rows are range-partitioned and ranked within their partition; each partition's offset is a sum over one
    count a partition.
    """
    parts = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    parts = parts.withColumn("_i", F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33))
    parts = settled(parts)
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = parts.count()
    step = max(1, total // wanted)
    rank = F.col("_i") + F.col("_before")
    return parts.join(F.broadcast(before), "_p").where((rank % step == 0) & (F.floor(rank / step) < wanted)).select(*df.columns)
