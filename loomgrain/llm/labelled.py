"""A bounded sample of labelled documents, gathered without moving the unlabelled ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.common import texts
from loomgrain.operators.shared import written

SAMPLE_PARTS = 8


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: Column | None = None, limit: int = 12_000) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``limit`` labelled rows, those of least id hash, written to the shared folder.

    ``rows`` restricts the label rows. Null ids and labels are passed over; an id with several labels has the
    largest; of the documents that share an id one is taken (the least text), so ids bound rows. At most ``limit`` ids
    (16 bytes each) are broadcast, so documents are joined where they are read and only the sample's texts are shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y"), (F.lit(True) if rows is None else rows).alias("_in"))
    known = known.where("_in and _id is not null and y is not null").groupBy("_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    joined = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
    one = joined.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
    return written(one.repartition(SAMPLE_PARTS, F.xxhash64("doc_id")), "labelled")
