"""Reports of earlier scans as relations: counts, samples, and what two of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators.sampling import every_nth
from loomgrain.plans.findings import FINDING


def load(spark: SparkSession, path: str, part: str = "issues") -> DataFrame:
    """``issues`` or ``insights`` of JSON reports, one row a finding; fields that are absent are null."""
    schema = f"version int, {part} array<struct<{', '.join(f'{n}: {t}' for n, t in FINDING.items())}, relativeFile: string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(part).alias("f")).select("f.*")


def counts_by_kind(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def sample(findings: DataFrame, kind: str, wanted: int = 12) -> DataFrame:
    """A systematic sample of one kind in file and line order."""
    key = F.concat_ws("\u0001", "relativeFile", F.lpad(F.coalesce("location.line", "primary.line", F.lit(0)).cast("string"), 9, "0"), F.to_json(F.struct("*")))
    return every_nth(findings.where(F.col("kind") == kind).withColumn("_key", key), "_key", wanted).drop("_key")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(file, symbol, side)`` of two ``(file, symbol)`` sets: shared, only-left or only-right."""
    a, b = left.select(F.col("file").alias("lf"), F.col("symbol").alias("ls")).distinct(), right.select(F.col("file").alias("rf"), F.col("symbol").alias("rs")).distinct()
    side = F.when(F.col("lf").isNull(), "only-right").when(F.col("rf").isNull(), "only-left").otherwise("shared")
    return a.join(b, (F.col("lf") == F.col("rf")) & (F.col("ls") == F.col("rs")), "full").select(F.coalesce("lf", "rf").alias("file"), F.coalesce("ls", "rs").alias("symbol"), side.alias("side"))


def hits_by_module(spark: SparkSession, path: str, top: int = 20) -> DataFrame:
    """``(module, hits, pct)`` of a CPU profile's nodes, the largest first."""
    nodes = spark.read.schema("nodes array<struct<hitCount: bigint, callFrame: struct<url: string>>>").json(path, multiLine=True).select(F.explode("nodes").alias("n"))
    module = F.coalesce(F.nullif(F.regexp_extract("n.callFrame.url", r"node_modules/((?:@[^/]+/)?[^/]+)", 1), F.lit("")), F.nullif(F.col("n.callFrame.url"), F.lit("")), F.lit("(native)"))
    sums = nodes.groupBy(module.alias("module")).agg(F.sum("n.hitCount").alias("hits"))
    total = sums.agg(F.sum("hits").alias("total"))  # one row
    return sums.crossJoin(F.broadcast(total)).select("module", "hits", (F.lit(100.0) * F.col("hits") / F.col("total")).alias("pct")).orderBy(F.desc("hits"), "module").limit(top)
