"""Measures, ranks, labels and text rules on small literal rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.functions import jsontext, labels, measures, text
from sessionlens.functions.ranking import Rank, distribution, exact_percentiles, numbered, running_sum


def one(df):
    return df.collect()[0]


def test_unknown_is_not_zero(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "k string, v bigint")
    got = {r.k: r.s for r in rows.groupBy("k").agg(measures.complete_sum("v").alias("s")).collect()}
    assert got == {"a": None, "b": 5}
    assert one(rows.where("k = 'none'").agg(measures.complete_sum("v").alias("s"))).s is None


def test_ratios_and_basis_points(spark):
    rows = spark.createDataFrame([(1, 3, 0), (5, 3, 1)], "a bigint, b bigint, z bigint")
    got = rows.select(
        measures.ratio("a", "z").alias("r"), measures.basis_points("a", "b").alias("bp"), measures.parts_per_million("a", "b").alias("ppm")
    ).collect()
    assert got[0].r is None and got[0].bp == 3333 and got[0].ppm == 333333
    assert got[1].r == 5.0 and got[1].bp == 10000 and got[1].ppm == 1000000


@pytest.mark.parametrize("width", [1, 9, 10_000])
def test_numbering_does_not_depend_on_the_split(spark, width):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.randrange(50)) for i in range(400)]
    rows = spark.createDataFrame(data, "k string, id bigint, t bigint").repartition(7)
    got = numbered(rows, ["k"], [F.col("t").asc(), F.col("id").asc()], "n", F.floor(F.col("t") / width))
    want = {}
    for key in {d[0] for d in data}:
        for n, d in enumerate(sorted((d for d in data if d[0] == key), key=lambda d: (d[2], d[1])), 1):
            want[d[1]] = n
    assert {r.id: r.n for r in got.collect()} == want
    total = running_sum(rows, ["k"], [F.col("t").asc(), F.col("id").asc()], F.col("t"), "s", F.floor(F.col("t") / width))
    sums = {}
    for key in {d[0] for d in data}:
        run = 0
        for d in sorted((d for d in data if d[0] == key), key=lambda d: (d[2], d[1])):
            run += d[2]
            sums[d[1]] = run
    assert {r.id: r.s for r in total.collect()} == sums


@pytest.mark.parametrize("width", [1, 13, 100000])
def test_percentiles_match_the_definitions(spark, width):
    rng = random.Random(2)
    values = [rng.randrange(1000) for _ in range(137)]
    rows = spark.createDataFrame([("x", v) for v in values] + [("y", 5), ("y", None)], "k string, v bigint")
    ranks = [Rank("lin", 0.9), Rank("flo", 0.9, "floor"), Rank("int", 90, "floor_int"), Rank("cei", 0.95, "ceil"), Rank("mid", 0, "middle"), Rank("tru", 0.95, "truncated")]
    got = {r.k: r for r in exact_percentiles(rows, ["k"], "v", ranks, width, with_max=True).collect()}
    s, n = sorted(values), len(values)
    x = got["x"]
    assert x["count"] == n and x["max"] == max(values)
    assert x.lin == pytest.approx(np.percentile(values, 90))
    assert x.flo == s[int((n - 1) * 0.9)] and x["int"] == s[(n - 1) * 90 // 100]
    assert x.cei == s[min(n - 1, max(0, int(n * 0.95 + 0.999999) - 1))]
    assert x.mid == s[(n - 1) // 2] and x.tru == s[min(n - 1, int(n * 0.95))]
    assert got["y"].lin == 5.0 and got["y"]["count"] == 1


def test_distribution_of_nothing(spark):
    row = one(distribution(spark.createDataFrame([], "v bigint"), [], "v"))
    assert row["count"] == 0 and row.p50 is None and row["max"] is None


@pytest.mark.parametrize(
    "value,tokens",
    [("", 0), ("abcd efgh", 2), ("hello, wörld", 6), ("a\x00b", None), ("中", 2), ("    \t\t\t\t", 2), ("\x01" * 3 + "abc", None)],
)
def test_structural_tokens(spark, value, tokens):
    assert one(spark.createDataFrame([(value,)], "t string").select(text.structural_tokens("t").alias("n"))).n == tokens


def test_tokens_never_fall_when_text_grows(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab _-\t\né中") for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = spark.createDataFrame([(b, b + rng.choice(["x", " ", "é", "\n"])) for b in base], "a string, b string")
    got = rows.select(text.structural_tokens("a").alias("a"), text.structural_tokens("b").alias("b")).collect()
    assert all(r.a <= r.b for r in got)


def test_common_prefix_is_in_bytes(spark):
    pairs = [("abc", "abd"), ("é", "è"), ("", "x"), ("same", "same"), ("a" * 5000, "a" * 4999 + "b")]
    rows = spark.createDataFrame(pairs, "a string, b string")

    def brute(a, b):
        a, b, n = a.encode(), b.encode(), 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    got = [r.n for r in rows.select(text.common_prefix("a", "b").alias("n")).collect()]
    assert got == [brute(*p) for p in pairs]


def test_tool_and_shell_families(spark):
    rows = spark.createDataFrame(
        [("git-status", "git status", ""), ("Grep", "rg x", "cargo test"), ("weather", None, None), (None, "", "hello")], "n string, c string, o string"
    )
    got = [(r.f, r.s) for r in rows.select(labels.tool_family("n").alias("f"), labels.shell_family("c", "o").alias("s")).collect()]
    assert got == [("version_control", "version_control"), ("search", "unknown"), ("unknown", "unknown"), ("unknown", "generic")]


@pytest.mark.parametrize("most", [1, 30, 10_000])
def test_numbering_by_size_of_the_groups(spark, most):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.randrange(50)) for i in range(300)]
    rows = spark.createDataFrame(data, "k string, id bigint, t bigint").repartition(5)
    order = [F.col("t").asc(), F.col("id").asc()]
    want = numbered(rows, ["k"], order, "n", F.floor(F.col("t") / 9))
    got = numbered(rows, ["k"], order, "n", F.floor(F.col("t") / 9), most=most)
    assert got.dtypes == want.dtypes
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


def test_rows_of_small_groups_are_shuffled_once(spark, tmp_path):
    """Numbering small groups deals their rows once; buckets are for groups that one task should not take."""
    spark.range(2000).selectExpr("id", "id % 300 as k").write.parquet(f"{tmp_path}/rows")
    out = numbered(spark.read.parquet(f"{tmp_path}/rows"), ["k"], [F.col("id").asc()], "n", F.floor(F.col("id") / 64), most=1000)
    assert out.agg(F.sum("n")).first()[0] == sum(i // 300 + 1 for i in range(2000))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") <= 2  # the rows, and the counts of the groups


def test_rows_without_a_bucket_have_one_place(spark):
    """A null in the second column of the order leaves a row without a bucket, in small and in large groups."""
    data = [("k", i, i % 4, None if i % 5 == 0 else i % 3) for i in range(60)]
    rows = spark.createDataFrame(data, "k string, id bigint, a bigint, b bigint")
    order, bucket = [F.col("a").asc(), F.col("b").asc(), F.col("id").asc()], F.col("a") * 10 + F.col("b")
    got = [sorted(numbered(rows, ["k"], order, "n", bucket, most=m).collect(), key=lambda r: r.id) for m in (1, 1000)]
    assert got[0] == got[1] == sorted(numbered(rows, ["k"], order, "n", bucket).collect(), key=lambda r: r.id)


def test_rows_are_rendered_with_one_encoder(monkeypatch):
    """A row of cells is encoded once, not cell by cell, and reads the same."""
    rows = [{"b": [1, {"y": "ü", "x": None}], "a": 1.5, "c": "q\"]"}, {"b": [], "a": True, "c": ""}]
    calls = []
    compact = jsontext.compact
    monkeypatch.setattr(jsontext, "compact", lambda value: calls.append(value) or compact(value))
    got = jsontext.readable(rows, "elision")
    assert got.split("\n")[2:] == ['(1.5,[1,{"x":null,"y":"ü"}],"q\\"]")', '(true,[],"")', ""]
    assert len(calls) == 3 + len(rows)
