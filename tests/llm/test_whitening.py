"""Embedding whitening against numpy on the distinct vectors, with odd rows between."""

import math
from collections import defaultdict

import numpy as np
import pytest

from ripplework.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n bigint, component int, x string"


def rows_of(vectors):
    return [(i, v, 0, 1, 2, "c") for i, v in enumerate(vectors)]


def exact(vectors):
    """{row: x} of the usable rows."""
    out = {}
    for i, v in enumerate(vectors):
        if v and all(c is not None and math.isfinite(c) for c in v):
            out[i] = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]
    return out


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(300, 24)) * np.linspace(0.05, 3, 24)).astype(np.float32).tolist()
    vectors = [None, [], [None] + base[0][1:], [float("nan")] + base[0][1:], [float("inf")] + base[0][1:], [1.0, 2.0], *base, *[base[7]] * 150, base[9]]
    got = whitening.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(5)).collect()
    xs = {i: x for i, x in exact(vectors).items() if len(x) == 24}
    fit = sorted(set(map(tuple, xs.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    trace = sum(sum((n * a - b) ** 2 for a, b in zip(x, s)) for x in fit) / n**3
    by = defaultdict(dict)
    for r in got:
        by[r["vec_id"]][r["component"]] = r
    assert set(by) == set(xs) and all(set(c) == set(range(1, 17)) for c in by.values())
    sign = {}
    for i, x in xs.items():
        c = np.array([(n * a - b) / n for a, b in zip(x, s)])
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        for k in range(1, 17):
            r, want = by[i][k], float(c @ v[:, k - 1] / math.sqrt(e[k - 1]))
            assert (r["n"], r["deviation"]) == (n, dev)
            assert r["explained"] == pytest.approx(e[k - 1] / trace, rel=1e-9) and r["identity_error"] < 1e-9
            if abs(want) > 0.1:
                sign.setdefault(k, np.sign(want) * np.sign(r["whitened"]))
            assert r["whitened"] == pytest.approx(sign.get(k, 1) * want, abs=1e-6) or abs(want) <= 0.1


def test_odd_tables(spark):
    make = lambda v: whitening.whiten(spark.createDataFrame(rows_of(v), SCHEMA))
    assert make([]).count() == 0 and make([None, []]).count() == 0
    assert make([[1.0, 2.0]] * 5).count() == 0  # one distinct vector has no variance
    flat = make([[float(i), 2.0 * i, 0.0] for i in range(20)] + [[3.0, 6.0, 0.0]] * 9).collect()  # one direction
    assert len(flat) == 29 and {r["component"] for r in flat} == {1}
    assert flat[0]["n"] == 20 and flat[0]["explained"] == pytest.approx(1) and flat[0]["identity_error"] < 1e-9


def test_wide_numbers_stay_exact(spark):
    """Deviations beyond a long are null, those of a long come by exact arithmetic."""
    got = whitening.whiten(spark.createDataFrame(rows_of([[3e12, 1.0], [-3e12, 0.5], [2e12, 0.0]]), SCHEMA)).collect()
    assert {r["deviation"] for r in got} == {None} and got[0]["identity_error"] < 1e-4
    assert whitening._limbs(-5)[-1] < 0 and sum(x << (30 * i) for i, x in enumerate(whitening._limbs(-5))) == -5
