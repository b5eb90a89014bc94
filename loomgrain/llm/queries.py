"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm import importance, kneser_ney, langid, minhash, packing, simhash, suffixes, toxicity, unigram, vafile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removals(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece_unigram,
        op2_minhash_fingerprints,
        op3_exact_top_k,
        op4_pattern_packing,
        op5_kneser_ney,
        op6_language_id,
        op7_toxicity,
        op8_simhash_components,
        op9_importance_resampling,
        op10_repeated_windows,
    )
}

#: The two whose results are integers and strings by a closed rule; tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_repeated_windows": """
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT rid, k, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT rid, k, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
        m AS (SELECT s, min(k) AS least FROM w GROUP BY s),
        c AS (SELECT rid, p, p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 50 IS NOT FALSE AS opens FROM w JOIN m USING (s) WHERE k > least),
        r AS (SELECT rid, p, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY rid ORDER BY p) AS run FROM c),
        spans AS (SELECT rid, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY rid, run),
        edges AS (SELECT rid, a, b FROM spans UNION ALL SELECT rid, length(h) // 2, NULL FROM d),
        kept AS (SELECT rid, a, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a, b NULLS LAST), 0) AS from_, a AS to_ FROM edges),
        texts AS (SELECT d.rid, string_agg(substr(d.h, 2 * from_ + 1, 2 * (to_ - from_)), '' ORDER BY from_) AS h FROM kept JOIN d USING (rid) GROUP BY d.rid),
        sums AS (SELECT rid, sum(b - a) AS gone, count(*) AS n FROM spans GROUP BY rid)
        SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(t.h)) AS kept_sha256
        FROM d JOIN texts t ON t.rid = d.rid LEFT JOIN sums ON sums.rid = d.rid""",
}
