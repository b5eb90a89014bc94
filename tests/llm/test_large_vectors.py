"""Exact top-k where a component is too large for exact sums of doubles."""

import numpy as np
from pyspark.sql import functions as F

from loomgrain.llm import vafile


def test_top_k_with_large_components_is_exact(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 5e6]) for i in range(120)] + [(120, [16_384.0] + [0.0] * 7)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {}
    for r in vafile.top_k(df, F.col("vec_id") % 20 == 0, k=20, block=32, query_block=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors}
    assert len(got) == 7
    for q, found in got.items():
        want = sorted((-sum(a * b for a, b in zip(ints[q], x)), i) for i, x in ints.items() if i != q)[:20]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
