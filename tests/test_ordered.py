"""As-of and interval joins and budget shards against plain Python, over many small ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplework.operators import ordered


def greedy(sizes, budget):
    """The shard of each row, as a writer that keeps one open tells it."""
    shard, held = -1, None
    for n in sizes:
        if held is None or held + n > budget:
            shard, held = shard + 1, 0
        held += n
        yield shard


@pytest.mark.parametrize(("rows", "fan", "budget"), [(1_000_000, 32, 100), (7, 2, 100), (5, 3, 13), (3, 2, 1), (11, 4, 5000)])
def test_shards_equal_a_plain_writer(spark, rows, fan, budget):
    rng = random.Random(rows * fan + budget)
    sizes = [rng.choice((0, 0, 1, 3, 9, 20, 60, 150)) for _ in range(400)]
    want = list(greedy(sizes, budget))
    table = [(3 * i - 50, n, "x") for i, n in enumerate(sizes)]
    rng.shuffle(table)
    df = spark.createDataFrame(table, "key bigint, n int, shard string").drop("shard")
    got = sorted(map(tuple, ordered.shards(df, "key", "n", budget, rows, fan).collect()))
    first = {}
    for i, s in enumerate(want):
        a = first.setdefault(s, [3 * i - 50, 0, 0])
        a[1] += 1
        a[2] += sizes[i]
    assert got == [(s, *v) for s, v in first.items()]
    assert {r["key"]: r["shard"] for r in ordered.with_shard(df, "key", "n", budget, rows).collect()} == {3 * i - 50: s for i, s in enumerate(want)}


def test_shards_of_nothing(spark):
    empty = spark.createDataFrame([], "key bigint, n int")
    assert ordered.shards(empty, "key", "n", 5).count() == 0 and ordered.with_shard(empty, "key", "n", 5).count() == 0


@pytest.mark.parametrize("rows", [1_000_000, 9])
def test_asof(spark, rows):
    rng = random.Random(2)
    left = [(i, rng.choice("aab") if i % 11 else None, rng.choice((7, 7, 7, rng.randrange(60), None))) for i in range(300)]
    right = [(rng.choice("aac"), rng.randrange(60) if i % 9 else None, i) for i in range(80)]
    got = ordered.asof_join(spark.createDataFrame(left, "i int, g string, t int"), spark.createDataFrame(right, "g string, t int, v int"), "t", ("g",), "v", rows)
    want = {}
    for i, g, t in left:
        ok = [(u, v) for h, u, v in right if h == g and g is not None and t is not None and u is not None and u <= t]
        want[i] = max(ok, default=None)
    assert {r["i"]: r["match"] and (r["match"]["t"], r["match"]["v"]) for r in got.collect()} == want
    alone = ordered.asof_join(spark.createDataFrame(left, "i int, g string, t int"), spark.createDataFrame(right, "h string, t int, v int"), "t", (), "v", rows)
    for r in alone.collect():
        ok = [(u, v) for _, u, v in right if r["t"] is not None and u is not None and u <= r["t"]]
        assert (r["match"] and (r["match"]["t"], r["match"]["v"])) == max(ok, default=None)


def test_intervals(spark):
    rng = random.Random(3)
    points = [(i, rng.choice("ab") if i % 13 else None, rng.choice((5.0, rng.uniform(-40, 40), None))) for i in range(300)]
    spans = []
    for j in range(120):
        a = rng.choice((5.0, round(rng.uniform(-40, 40), 2), -8.0))
        spans.append((j, rng.choice("ab"), a if j % 10 else None, a + rng.choice((0.0, 0.001, 1.0, 8.0, 60.0, -1.0))))
    got = ordered.interval_join(spark.createDataFrame(points, "i int, g string, x double"), spark.createDataFrame(spans, "j int, g string, low double, high double"), "x", "low", "high", ("g",))
    want = {(i, j) for i, g, x in points for j, h, a, b in spans if x is not None and a is not None and g == h and a <= x <= b}
    rows = [(r["i"], r["match"]["j"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    none = spark.createDataFrame([], "j int, g string, low double, high double")
    assert ordered.interval_join(spark.createDataFrame(points, "i int, g string, x double"), none, "x", "low", "high", ("g",)).count() == 0


def test_interval_sums(spark):
    rng = random.Random(9)
    points = [(rng.randrange(200), rng.choice((None, rng.randrange(-999, 999) / 100))) for _ in range(500)] + [(None, 1.0)]
    spans = [(j, low, low + rng.randrange(-2, 40)) for j, low in enumerate(rng.randrange(-20, 220) for _ in range(80))] + [(900, None, 3), (901, 5, None)]
    want = {}
    for j, low, high in spans:
        mine = [v for t, v in points if None not in (t, low, high) and low <= t <= high]
        if mine:
            some = [v for v in mine if v is not None]
            want[j] = (len(mine), round(sum(some), 4) + 0.0 if some else None)
    for rows in (30, 1_000_000):
        got = ordered.interval_sums(spark.createDataFrame(points, "t bigint, v double"), spark.createDataFrame(spans, "j int, low bigint, high bigint"), "t", "v", "low", "high", rows=rows)
        assert {r["j"]: (r["n"], None if r["total"] is None else round(r["total"], 4) + 0.0) for r in got.collect()} == want


def test_events_near_errors_joins_no_pairs(spark):
    """Each event met each error around it before: a join on bins; now only running sums are joined, at the ends of spans."""
    from ripplework.plans.catalogue import queries

    plan = queries()["events_near_errors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" not in plan and "__level" not in plan


def test_interpolate_by_running_windows(spark):
    """A frame up to the last row was gone through again for each row: quadratic in the rows of a range."""
    from ripplework.operators import core

    rng = random.Random(3)
    rows = [(s, i, None if rng.random() < 0.6 or (s, i // 20) in ((1, 0), (2, 9)) else float(rng.randrange(99))) for s in range(4) for i in range(200) if s < 3 or i < 5]
    for cells in (1, 7):
        df = core.interpolate(spark.createDataFrame(rows, "s int, x bigint, y double"), "s", "x", "y", cells)
        assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
        got = {(r["s"], r["x"]): r["y"] for r in df.collect()}
        for s in range(4):
            known = [(i, y) for t, i, y in rows if t == s and y is not None]
            for t, i, _ in rows:
                if t == s:
                    want = float(np.interp(i, *zip(*known, strict=True))) if known else None
                    assert got[s, i] == (None if want is None else pytest.approx(want))


def test_answer_offset_works_its_place_out_once(spark):
    """The place behind the marker stood in the fold over tokens, so it was worked out again for each token."""
    from ripplework.operators import positions

    df = spark.createDataFrame([(1, ["so ", "## ", "####", " 4", "2"]), (2, ["none"]), (3, ["Ans", "wer: ", "7"]), (4, ["####"]), (5, [])], "i int, t array<string>")
    out = df.select("i", positions.answer_offset(F.col("t"), ["####", "Answer:"]).alias("at"))
    assert {r["i"]: r["at"] for r in out.collect()} == {1: 3, 2: None, 3: 2, 4: None, 5: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("array_join(") == 1


def test_retokenise_deals_no_converted_tokens(spark):
    """Characters were carried through the running sum of lengths before, several times the size of the words."""
    from ripplework.operators import core

    docs = spark.createDataFrame([(1, "a", ["ab", "c"]), (2, "b", ["def"]), (3, "b", [])], "i int, s string, t array<string>")
    out = core.retokenise(docs, "i", "t", "s", lambda w: F.filter(F.split(F.array_join(w, ""), ""), lambda x: x != ""), 3, "/")
    assert [(r["chunk_index"], r["token_ids"], r["label"]) for r in out.orderBy("chunk_index").collect()] == [(0, ["a", "b", "c"], "a"), (1, ["/", "d", "e"], "mixed"), (2, ["f", "/", "/"], "b")]
    assert "__tok" not in out._jdf.queryExecution().optimizedPlan().toString().split("Window [", 1)[1]
