"""Tile scores against dense arrays, leaves of nested JSON against a recursive walk, AUC and recall against sorting."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplework.operators import core, nested, sparse


@pytest.mark.parametrize(("queries", "candidates", "zeros"), [(512, 4096, True), (3, 7, True), (4, 1000, False)])
def test_outer_products(spark, queries, candidates, zeros):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        for _ in range(rng.randrange(6)):
            entries = [(rng.choice((0, 1, rng.randrange(50))), rng.uniform(-1, 1)) for _ in range(rng.randrange(4))]
            rows.append((i, entries, [rng.uniform(-1, 1) for _ in range(3)]))
    r = sparse.outer_products(spark.createDataFrame(rows, "r bigint, e array<struct<index:int,value:double>>, h array<double>"), "r", "e", "h", 3)
    full = np.zeros((60, 50, 3))
    for i, entries, h in rows:
        for v, x in entries:
            full[i, v] += x * np.array(h)
    got = {(x["q"], x["c"]): x["score"] for x in sparse.tile_scores(r, "r", "index", "vector", F.col("r") % 4 == 0, zeros, queries, candidates).collect()}
    here = [i for i in range(60) if any(e for j, e, _ in rows if j == i)]
    want = {(i, j): float((full[i] * full[j]).sum()) for i in here for j in here if i % 4 == 0 and i != j}
    want = want if zeros else {k: v for k, v in want.items() if (np.abs(full[k[0]]).sum(1) * np.abs(full[k[1]]).sum(1)).any()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    # the Gram form: sums over pairs of positions of (error, error) times (hidden, hidden)
    dot = lambda a, b: sum(x * y for v, x in a for w, y in b if v == w)
    for i, j in list(want)[:40]:
        gram = sum(dot(e, f) * float(np.dot(h, g)) for a, e, h in rows if a == i for b, f, g in rows if b == j)
        assert got[i, j] == pytest.approx(gram, abs=1e-12)


def test_records_are_not_copied_for_the_blocks_they_meet(spark):
    """Each packed record was shuffled once for each block of the other side."""
    rng = random.Random(4)
    rows = [(f"r{i}", w, [float(rng.randrange(1, 5))]) for i in range(40) for w in {rng.choice("abcdefgh") + rng.choice("xy") for _ in range(5)}]
    got = sparse.tile_scores(spark.createDataFrame(rows, "r string, w string, n array<double>"), "r", "w", "n", F.col("r") < "r2", False, 3, 7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" in plan and "Repartition" not in plan and "Generate" not in plan
    has = {r: {w: n[0] for s, w, n in rows if s == r} for r, _, _ in rows}
    want = {(q, c): sum(n * has[c].get(w, 0) for w, n in has[q].items()) for q in has for c in has if q < "r2" and q != c}
    assert {(r["q"], r["c"]): r["score"] for r in got.collect()} == {k: s for k, s in want.items() if s}


def test_string_leaves(spark):
    rng = random.Random(2)

    def made(depth):
        pick = rng.randrange(7) if depth else 0
        if pick == 5:
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        if pick == 6:
            return {rng.choice("abcde") * k: made(depth - 1) for k in range(1, rng.randrange(1, 4))}
        return rng.choice(("", "a", 'q"\\', "é\n語", "x" * 50, rng.randrange(9), None, True, 1.5))

    def walk(v):
        return [v] if isinstance(v, str) else [x for w in (v.values() if isinstance(v, dict) else v) for x in walk(w)] if isinstance(v, (dict, list)) else []

    docs = [[made(6), {"k": made(6)}] for _ in range(80)] + ["plain", 3, None, [], {}]
    rows = [(i, json.dumps(d, ensure_ascii=bool(i % 2))) for i, d in enumerate(docs)] + [(900, None), (901, " ")]
    got = nested.string_leaves(spark.createDataFrame(rows, "id int, body string"), F.col("body"), "id").collect()
    assert sorted((r["id"], r["leaf"]) for r in got) == sorted((i, x) for i, d in enumerate(docs) for x in walk(d))
    assert len({(r["id"], r["path"]) for r in got}) == len(got)
    bad = spark.createDataFrame([(1, "{"), (2, '["ok"]')], "id int, body string")
    assert [r["leaf"] for r in nested.string_leaves(bad, F.col("body"), "id", strict=False).collect()] == ["ok"]
    with pytest.raises(Exception, match="MALFORMED"):
        nested.string_leaves(bad, F.col("body"), "id").collect()


def test_auc_recall(spark):
    rng = random.Random(3)
    rows = [(q, rng.choice((0.5, round(rng.random(), 1), rng.random())), c, rng.random() < 0.3 and q > 1) for q in range(6) for c in range(200)]
    got = {r["q"]: (r["auc"], r["recall"]) for r in core.auc_recall(spark.createDataFrame(rows, "q int, s double, c int, y boolean"), "q", "s", "c", "y", 5).collect()}
    for q in range(6):
        mine = [(s, c, y) for a, s, c, y in rows if a == q]
        pos, neg = [s for s, _, y in mine if y], [s for s, _, y in mine if not y]
        if not pos:
            assert got[q] == (None, None)
            continue
        auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        top = sorted(mine, reverse=True)[: len(pos)]
        assert got[q][0] == pytest.approx(auc) and got[q][1] == pytest.approx(sum(y for *_, y in top) / len(pos))
