"""What must raise, odd inputs, and two-phase operators beside plain ones."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ripplework.operators import core as O
from ripplework.operators import positions as P
from ripplework.operators import records as R
from ripplework.sources import io


def test_checks_raise(spark):
    a = spark.createDataFrame([(1, "x", [1, 2], [3])], "k int, v string, p array<int>, q array<int>")
    for match, make in (
        ("lengths differ", lambda: R.zipped(a, "p", "q")),
        ("no pattern fits", lambda: R.mapped(a, "v", [("y%", "why")])),
        ("k without metadata", lambda: R.with_metadata(a.select("k", F.col("k").alias("j")), a.select(F.lit(7).alias("i"), "v"), "i", "k", "j")),
        ("group of other than 2", lambda: R.sized_groups(a, "v", 2)),
        ("variants differ", lambda: R.paired_variants(a.select("k", "v"), a.select("k", F.lit("z").alias("v")), "k", ["v"])),
        ("key sets differ", lambda: R.paired_variants(a.select("k", "v"), a.select((F.col("k") + 1).alias("k"), "v"), "k", ["v"])),
    ):
        with pytest.raises(Exception, match=match):
            make().collect()
    with pytest.raises(ValueError, match="no prompt"):
        R.pair_messages(a)
    with pytest.raises(ValueError, match="wanted"):
        R.at_least(a, 2, "probe")
    with pytest.raises(ValueError, match="no column"):
        R.canonical(a, {"z": [("none", 1.0)]})
    with pytest.raises(ValueError, match="unknown mode"):
        P.update_positions(F.col("p"), F.col("q"), "last")
    with pytest.raises(ValueError, match="unknown dataset"):
        io.Registry().load("none")


def test_messages(spark):
    t = spark.createDataFrame([(["hi", " ", "yo"], [("", "a"), ("Bot", " b "), ("tool", "c"), (None, None)])], "s array<string>, r array<struct<role:string,content:string>>")
    r = t.select(R.turn_messages(F.col("s")).alias("a"), R.turn_messages(F.col("r"), "role", "content").alias("b"), R.answered(R.turn_messages(F.col("s"))).alias("ok")).first()
    assert [tuple(m) for m in r["a"]] == [("user", "hi"), ("user", "yo")] and not r["ok"]
    assert [tuple(m) for m in r["b"]] == [("user", "a"), ("assistant", "b"), ("tool", "c")]


def test_positions(spark):
    x = spark.createDataFrame([([5, -100, 7, 8], [1, 1, 0, 1], ["a #", "### ", " b", "c"])], "l array<int>, m array<int>, t array<string>")
    at = P.answer_offset(F.col("t"), ["####", "none"])
    r = x.select(P.supervised_positions(F.col("l"), F.col("m")).alias("p"), P.supervised_positions(F.slice("l", 1, 1)).alias("e"), P.supervised_positions(F.col("l"), None, 1).alias("one"), at.alias("at"), P.answer_offset(F.col("t"), ["zzz"]).alias("no")).first()
    assert (r["p"], r["e"], r["one"], r["at"], r["no"]) == ([3], [], [2], 2, None)
    assert P.causal(spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (1, 3, 4.0)], "s int, p int, v double"), "s", "p", "v", "o").collect() == [(1, 1, 3.0, 2.0)]  # no score over a gap


def test_recurrences_in_ranges(spark):
    rng = random.Random(2)
    rows = [(s, i, rng.random()) for s in ("a", None, "c") for i in range(200 if s else 1)]
    df = spark.createDataFrame(rows, "s string, x long, y double")
    ema = {(r["s"], r["x"]): r["ema"] for r in O.ema(df, "s", "x", "y", 0.3).collect()}
    past = {(r["s"], r["x"]): r["h"] for r in O.decayed_mean(df, "s", "x", "y", 0.9, "h").collect()}
    assert len(ema) == len(past) == len(rows)
    for s in ("a", None, "c"):
        e, top, w = None, 0.0, 0.0
        for _, x, y in [r for r in rows if r[0] == s]:
            assert past[s, x] is None if w == 0 else past[s, x] == pytest.approx(top / w)
            e = y if e is None else 0.3 * y + 0.7 * e
            assert ema[s, x] == pytest.approx(e)
            top, w = 0.9 * (top + y), 0.9 * (w + 1)


def test_rolling_windows_over_runs(spark):
    rng = random.Random(3)
    y = [rng.choice([1.0, 2.0, 50.0]) for _ in range(120)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(y)], "s string, x long, y double")
    got = {r["x"]: (r["med"], r["mad"]) for r in O.rolling_mad(df, "s", "x", "y", rows=20).collect()}
    med = [statistics.median(y[max(0, i - 4) : i + 5]) for i in range(len(y))]
    dev = [abs(a - b) for a, b in zip(y, med, strict=True)]
    assert got == {i: (med[i], statistics.median(dev[max(0, i - 4) : i + 5])) for i in range(len(y))}


def test_null_groups_and_gaps(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 2, 4.0), (None, 3, None), (None, 4, None), (None, 5, 10.0), (None, 6, None), ("a", 1, None)], "s string, x long, y double")
    got = {(r["s"], r["x"]): r["y"] for r in O.interpolate(df, "s", "x", "y", cells=4).collect()}
    assert got == {(None, 1): 4.0, (None, 2): 4.0, (None, 3): 6.0, (None, 4): 8.0, (None, 5): 10.0, (None, 6): 10.0, ("a", 1): None}
    n = O.prefix_sum(df.withColumn("one", F.lit(1).cast("bigint")), "x", "one", ("s",), rows=2).collect()
    assert sorted((r["s"] or "", r["x"], r["before"]) for r in n) == [("", i, i - 1) for i in range(1, 7)] + [("a", 1, 0)]


def test_ranks_and_places(spark):
    df = spark.createDataFrame([("g", v) for v in (3.0, 1.0, 3.0, None, 2.0)], "g string, v double")
    assert sorted((r["v"], r["r"]) for r in O.with_average_rank(df, "v", ("g",), "r").where("v is not null").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]
    got = O.numbered(spark.range(500).withColumn("key", F.xxhash64("id")), "key", "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(500)) and [r["key"] for r in got] == sorted(r["key"] for r in got)
    q = spark.range(50).select(F.col("id").alias("q"))
    assert O.cross_pairs(q, spark.range(7), rows=8).distinct().count() == 350 == O.cross_pairs(q, spark.range(7)).count()


def test_yaml():
    text = "a: 1\nb:\n- x\n- 2.5\nc:\n  d: 'q: r'  # note\n  e:\n    - true\n  f: [1, no]\n# end\ng: ~\n"
    assert io.parse_yaml(text) == {"a": 1, "b": ["x", 2.5], "c": {"d": "q: r", "e": [True], "f": [1, "no"]}, "g": None}
    with pytest.raises(ValueError, match="not understood"):
        io.parse_yaml("a: 1\nnothing\n")


def test_discard_keeps_the_last(spark):
    from ripplework import session

    mark = session.written()
    some = [session.materialize(spark.range(i + 1), "kept") for i in range(3)]
    session.discard(spark, mark)
    assert some[2].count() == 3 and session.written() == mark + 1
    with pytest.raises(Exception, match="(?i)exist"):
        some[0].count()
    session.discard(spark, session.written())
    assert some[2].count() == 3
