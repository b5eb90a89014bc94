"""The training-data pipeline: each stage takes (spark, docs, sf_dir) and returns the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm import importance, langid, neighbours, packing, suffixes
from loomgrain.llm.common import fresh

#: Bytes that a passage must share with an earlier document to be cut: whole sentences go, stock phrases stay.
PASSAGE = 100


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is recognised: null texts, texts without a letter, scores under 0.2."""
    profiles = langid.learn_profiles(docs)
    language, score = fresh(docs, "language", "score")
    known = (F.col(language) != langid.UNKNOWN) & (F.col(score) >= 0.2)
    return langid.identify(docs, profiles, keep=tuple(docs.columns), names=(language, score)).where(known).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling towards the labelled good ones selects."""
    return importance.select_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return neighbours.keep_one_of_each(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that also begin in a document of a smaller id; ``n_chars`` is what is left."""
    cut = suffixes.deduplicate(docs, window=PASSAGE, gram=48)
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens; one row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("importance_resampling", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", passage_stage),
    ("pattern_packing", packing_stage),
]

#: Trained models and packing aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder so that none runs twice."""
    from loomgrain.operators.shared import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
