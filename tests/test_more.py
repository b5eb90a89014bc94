import json

import pytest
from pyspark.sql import functions as F

from loomgrain.functions import text as T
from loomgrain.plans import compare
from loomgrain.streaming import watch


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (T.basename, "a\\b/c.ts", "c.ts"), (T.dirname, "a/b/c.ts", "a/b"), (T.dirname, "c.ts", ""), (lambda c: T.relative(c, "/r"), "/r/a/b", "a/b"), (lambda c: T.relative(c, "/r"), "/rx/a", "/rx/a"),
        (T.without_extension, "a.test.tsx", "a.test"), (T.normalized, "a/./b/../c", "a/c"), (T.normalized, "../a/../../b", "../../b"), (T.normalized, "/a//b/", "/a/b"), (lambda c: T.shortened(c, 6), "abcdefgh", "abc..."),
        (T.without_space, " a b\n", "ab"), (T.version_base, "CardV2", "Card"), (T.version_base, "Card", ""), (T.callee_of, "go(x)", "go"), (T.callee_of, "a.b(x)", ""),
    ],
)
def test_text_functions(spark, f, given, wanted):
    assert one(spark, f(F.col("x")), x=given) == wanted


def test_number_functions(spark):
    assert one(spark, T.clamp01(F.col("x")), x=1.7) == 1.0 and one(spark, T.clamp01(F.col("x")), x=-0.1) == 0.0
    assert one(spark, T.plural(F.col("x"), "file"), x=1) == "1 file" and one(spark, T.plural(F.col("x"), "file"), x=2) == "2 files"
    assert one(spark, T.seconds(F.col("x")), x=5640) == "5.6s"


def test_reports_as_relations(spark, tmp_path):
    issues = [{"kind": "dead-code", "confidence": 0.9, "symbol": f"s{i}", "location": {"file": "/r/a.ts", "line": i, "column": 1}, "relativeFile": "a.ts"} for i in range(30)] + [{"kind": "empty-catch", "confidence": 0.8, "relativeFile": "b.ts"}]
    (tmp_path / "r.json").write_text(json.dumps({"version": 1, "issues": issues, "insights": []}, indent=1))
    loaded = compare.load(spark, str(tmp_path / "r.json"))
    assert [tuple(r) for r in compare.counts_by_kind(loaded).collect()] == [("dead-code", 30), ("empty-catch", 1)]
    assert sorted(r["location"]["line"] for r in compare.sample(loaded, "dead-code", 10).collect()) == list(range(0, 30, 3))
    other = spark.createDataFrame([("a.ts", "s1"), ("z.ts", "q")], "file string, symbol string")
    mine = loaded.where("symbol is not null and location.line < 3").select(F.col("relativeFile").alias("file"), "symbol")
    assert {tuple(r) for r in compare.compare(mine, other).collect()} == {("a.ts", "s0", "only-left"), ("a.ts", "s1", "shared"), ("a.ts", "s2", "only-left"), ("z.ts", "q", "only-right")}


def test_profile(spark, tmp_path):
    nodes = [{"hitCount": 3, "callFrame": {"url": "file:///x/node_modules/@s/a/i.js"}}, {"hitCount": 1, "callFrame": {"url": ""}}, {"hitCount": 4, "callFrame": {"url": "file:///x/node_modules/@s/a/j.js"}}]
    (tmp_path / "p.json").write_text(json.dumps({"nodes": nodes}))
    assert [tuple(r) for r in compare.hits_by_module(spark, str(tmp_path / "p.json")).collect()] == [("@s/a", 7, 87.5), ("(native)", 1, 12.5)]


def test_facts_from_a_stream(spark, tmp_path):
    schema = "file string, rel string, text string, changed_at long"
    spark.createDataFrame([("/r/a.ts", "a.ts", "export const a = 1;", 1), ("/r/a.ts", "a.ts", "export const b = 1;", 2)], schema).write.json(str(tmp_path / "in"))
    watch.keep_facts(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    now = watch.current_facts(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert [d["symbol"] for d in now[0]["decls"]] == ["b"] and len(now) == 1
