"""An extension: keep facts up to date from a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgrain.frontend.facts import extract


def keep_facts(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the facts of each version of ``changes(file, rel, text, changed_at)`` to ``target``, with ``changed_at``.

    Parsing is stateless, so there is no watermark; a batch that runs again writes its own folder anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.withColumn("_r", F.row_number().over(Window.partitionBy("rel").orderBy(F.desc("changed_at")))).where("_r = 1")
        facts = extract(latest).join(latest.select("rel", "changed_at"), "rel")
        facts.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_facts(facts: DataFrame) -> DataFrame:
    """The latest version of each file among all batches read back."""
    newest = facts.groupBy("rel").agg(F.max("changed_at").alias("changed_at"))
    return facts.join(newest, ["rel", "changed_at"])
