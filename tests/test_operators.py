"""Generic operators against brute force, and the catalogue against its SQL."""

import random
from collections import Counter

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrain.operators import graph, joins, ngrams
from loomgrain.operators.sampling import every_nth
from loomgrain.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 330)] + [(None, 1), (7, 7)]
    got = dict(tuple(x) for x in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    root = {n: n for e in edges if None not in e for n in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a is not None:
            root[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {n: top(n) for n in root}


def test_reachable_and_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 6)], "src int, dst int")
    roots = spark.createDataFrame([(1,), (9,), (None,)], "node int")
    assert {tuple(r) for r in graph.reachable(edges, roots).collect()} == {(1, 0), (9, 0), (2, 1), (3, 2)}
    succ = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (5, 1), (6, 9), (7, 7)], "node int, next int")
    assert {r["node"]: r["path"] for r in graph.chains(succ).collect()} == {1: [1, 2, 3, 4], 2: [2, 3, 4], 3: [3, 4, 2], 4: [4, 2, 3], 5: [5, 1, 2, 3, 4], 6: [6], 7: [7]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("ab"), min_size=0, max_size=14), min_size=2, max_size=3))
def test_islands_are_maximal_matches(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t array<string>")
    wins = ngrams.windows(df, "id", "t", 3)
    got = {tuple(r) for r in ngrams.maximal_matches(ngrams.star_pairs(wins, "id", 3, None), 3).collect()}
    first = {}
    pairs = set()
    for i, t in enumerate(texts):
        for p in range(len(t) - 2):
            key = tuple(t[p : p + 3])
            a = first.setdefault(key, (i, p))
            if a != (i, p) and (a[0] != i or p - a[1] >= 3):
                pairs.add((a[0], i, a[1], p))
    want = set()
    for a, b, x, y in pairs:
        if (a, b, x - 1, y - 1) not in pairs:
            n = 0
            while (a, b, x + n, y + n) in pairs:
                n += 1
            want.add((a, b, x, y, n + 2))
    assert got == want


def test_asof_prefix_candidates_and_sampling(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 9, "a"), (1, 20, "b"), (1, 21, "c"), (2, 6, "d")], "k int, t int, v string")
    assert {(r["k"], r["t"]): r["last_v"] for r in joins.backward_asof(left, right, ["k"], "t", "v").collect()} == {(1, 10): "a", (1, 20): "b", (2, 5): None}
    rng = random.Random(4)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(60)]), i) for i in range(200)], "k int, t int, i int")
    right = spark.createDataFrame([(rng.choice([1, 1, 2, 3, None]), rng.choice([None, *range(60)]), rng.choice(["x", "y", None])) for _ in range(40)], "k int, t int, v string")
    whole = joins.backward_asof(left, right, ["k"], "t", "v").collect()
    assert Counter(joins.backward_asof(left, right, ["k"], "t", "v", bucket=F.floor(F.col("t") / 7)).collect()) == Counter(whole)
    hits = right.collect()
    for r in whole:
        if r["k"] is not None and r["t"] is not None:
            earlier = [x["t"] for x in hits if x["k"] == r["k"] and x["t"] is not None and x["t"] <= r["t"]]
            assert not earlier or r["matched"] == max(earlier)
    paths = spark.createDataFrame([("a/b/c",), ("a/bc",), ("z",)], "p string")
    owners = spark.createDataFrame([("a",), ("a/b",)], "o string")
    assert {r["p"]: r["owner"] for r in joins.longest_prefix(paths, "p", owners, "o").collect()} == {"a/b/c": "a/b", "a/bc": "a", "z": None}
    assert sorted(r[0] for r in every_nth(spark.range(100), "id", 12).collect()) == list(range(0, 96, 8))


def test_identity_ratio(spark):
    row = spark.range(1).select(ngrams.identity_ratio(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "abx"))).alias("r"), ngrams.identity_ratio(F.array().cast("array<string>"), F.array(F.lit("a"))).alias("n")).first()
    assert row["r"] == pytest.approx(2 / 3) and row["n"] is None


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(map(tidy, r)) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(tidy, r)) for r in df.select(columns).collect()), key=repr) == want
