"""Checks, subsets and failed rows on small cases."""

import pytest
from pyspark.sql import functions as F

from ripplework.operators import checks
from ripplework.operators import core as O


def test_ranking_faults(spark):
    known = spark.createDataFrame([(i, f"m{i}") for i in range(9)], "c int, m string")
    rows = [("good", r, r, f"m{r}") for r in (1, 2, 3)] + [("gap", 1, 1, "m1"), ("gap", 3, 2, "m2")] + [("twice", 1, 4, "m4"), ("twice", 2, 4, "m4")] + [("meta", 1, 5, "m6")] + [("unknown", 1, 77, "m0")] + [("tie", 1, 1, "m1"), ("tie", 1, 2, "m2")]
    got = {r["q"]: tuple(r)[1:] for r in checks.ranking_faults(spark.createDataFrame(rows, "q string, r int, c int, m string"), "q", "r", "c", known, ["m"]).collect()}
    assert got == {"good": (3, True, True, True), "gap": (2, False, True, True), "twice": (2, True, False, True), "meta": (1, True, True, False), "unknown": (1, True, True, False), "tie": (2, False, True, True)}


def test_logs(spark):
    rows = [("a", i, v) for i, v in enumerate((5.0, None, 4.0, 3.0, 2.0))] + [("b", 0, 1.0), ("b", 1, float("nan"))] + [("c", 3, 1.0)]
    got = {r["run"]: tuple(r)[1:] for r in checks.log_summary(spark.createDataFrame(rows, "run string, step int, loss double"), "run", "step", "loss").collect()}
    assert got["a"] == (4, True, 5.0, 3.0, 2.0, True) and got["c"] == (1, True, 1.0, 1.0, 1.0, False) and got["b"][:3] == (2, False, 1.0)


def test_subsets(spark):
    df = spark.createDataFrame([(t, i) for t, n in (("big", 30), ("mid", 12), ("few", 7), ("one", 1)) for i in range(n)], "t string, k int")
    count = {(r["t"], r["subset"]): r["count"] for r in checks.subsets(df, "t", "k", 10, 8, 1, smaller=True).groupBy("t", "subset").count().collect()}
    assert count == {("big", "train"): 10, ("big", "probe"): 8, ("mid", "train"): 4, ("mid", "probe"): 8, ("few", "train"): 6, ("few", "probe"): 1, ("one", "train"): 1}
    with pytest.raises(Exception, match="fewer than 18"):
        checks.subsets(df, "t", "k", 10, 8, 1).collect()


def test_what_must_be_refused(spark):
    a, b = (spark.createDataFrame([(i, "x") for i in some], "k int, v string") for some in ((1, 2, 3), (3, 4)))
    assert checks.require_disjoint(a, b.where("k > 3"), "k").count() == 3 and [r["k"] for r in checks.overlap(a, b, "k").collect()] == [3]
    with pytest.raises(Exception, match="both sides"):
        checks.require_disjoint(a, b, "k").collect()
    with pytest.raises(Exception, match="key sets differ"):
        O.join_equal_keys(a, b.withColumnRenamed("v", "w"), ["k"]).collect()
    good, bad = checks.attempted(a, F.try_divide(F.lit(6), F.col("k") - 2), "y", "zero")
    assert sorted(r["y"] for r in good.collect()) == [-6.0, 6.0] and [(r["k"], r["__why"]) for r in bad.collect()] == [(2, "zero")]


def test_held_out_and_bins(spark):
    df = spark.createDataFrame([("a", i, i % 2) for i in range(10)] + [("b", 1, 1)], "g string, o int, ok int")
    got = sorted((r["g"], r["o"], r["part"]) for r in checks.first_valid(df, "g", "o", F.col("ok") == 1, 2).collect())
    assert got == [("a", 1, "held"), ("a", 3, "held"), ("a", 5, "train"), ("a", 7, "train"), ("a", 9, "train"), ("b", 1, "held")]
    h = O.histogram(spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 9.9), ("a", None), ("b", 3.0), ("b", 3.0), ("c", None)], "g string, x double"), "g", "x", 5)
    assert sorted(map(tuple, h.collect())) == [("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("a", 4, 2), ("b", 0, 2)]


def test_conversion_resumes_and_keeps_what_it_must(spark):
    """Chinese for the mathematics, French for answers, code as it is; done records are passed over."""
    kind = "example_id string, task string, messages array<struct<role:string,content:string>>"
    talk = lambda *c: [("user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(c)]
    rows = [("1", "mbpp", talk("code", "x = 1")), ("2", "gsm8k", talk("2 and 3?", "<<2+3=5>> #### 5")), ("3", "dolly_qa", talk("why", "so", "and")), ("4", "gsm8k", talk("old"))]
    df, done = spark.createDataFrame(rows, kind), spark.createDataFrame([("4",)], "example_id string")

    def mark(texts, languages):
        return languages.str[:2] + ":" + texts

    got = {r["example_id"]: (r["target_language"], r["translation_status"], [m["content"] for m in r["messages"]], [m["role"] for m in r["messages"]]) for r in checks.converted(df, done, mark).collect()}
    assert got == {"1": ("English", "unchanged", ["code", "x = 1"], ["user", "assistant"]), "2": ("Chinese", "translated", ["Ch:2 and 3?", "Ch:<<2+3=5>> #### 5"], ["user", "assistant"]), "3": ("French", "translated", ["Fr:why", "Fr:so", "Fr:and"], ["user", "assistant", "user"])}
    with pytest.raises(Exception, match="unsupported task"):
        checks.converted(spark.createDataFrame([("1", "other", talk("x"))], kind)).collect()
    bad = [("1", "mbpp", talk("code", "x = 2")), ("2", "gsm8k", [("user", "2 and 4?"), ("user", "<<2+3=6>> #### 6")]), ("3", "dolly_qa", talk("pourquoi", " ", "et")), ("9", "mbpp", talk("new"))]
    errors = {r["example_id"]: r["errors"] for r in checks.record_errors(df, spark.createDataFrame(bad, kind)).collect()}
    assert errors == {"1": ["messages changed"], "2": ["role changed", "numbers changed", "annotations changed", "answer changed"], "3": ["empty message"], "4": ["missing output"], "9": ["missing source"]}
    short = checks.record_errors(df, df.withColumn("messages", F.slice("messages", 1, 1))).collect()
    assert {r["example_id"]: r["errors"] for r in short} == {"1": ["message count changed"], "2": ["message count changed"], "3": ["message count changed"], "4": []}
