"""Retokenised streams: documents are dealt once, as they are, and chunks inside a range are put together there."""

import re

import pytest
from pyspark.sql import functions as F

from ripplework.operators import core


@pytest.mark.parametrize("length", [1, 5, 64, 400])
def test_ranges(spark, monkeypatch, length):
    monkeypatch.setattr(core, "RANGE_DOCS", 3)
    docs = [(i, f"s{i // 4 % 3}", None if i % 11 == 5 else " ".join(f"w{i}x{j}" for j in range(i * 7 % 13))) for i in range(50)]
    df = spark.createDataFrame(docs, "i bigint, s string, text string").repartition(7)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    out = core.retokenise(df, "i", words, "s", lambda w: F.filter(F.split(F.array_join(w, ""), ""), lambda x: x != ""), length, "/")
    stream = [(c, s) for _, s, t in docs for c in [*(t or "").replace(" ", ""), "/"]]
    want = []
    for k in range(len(stream) // length):
        part = stream[k * length : (k + 1) * length]
        kinds = {s for _, s in part}
        want.append((k, [c for c, _ in part], kinds.pop() if len(kinds) == 1 else "mixed"))
    assert sorted(map(tuple, out.collect())) == want


def test_documents_are_dealt_once(spark):
    df = spark.range(20_000).select("id", F.lit("s").alias("s"), F.repeat(F.lit("ab cd "), 3).alias("text"))
    out = core.retokenise(df, "id", F.split("text", " "), "s", lambda w: F.split(F.array_join(w, " "), ""), 16, "/")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#[^\n]*", plan)
    assert dealt.count("chunk_index") == 1  # of chunks across two ranges only
    assert "ReusedExchange" in plan
    plan, depth, windows = out._jdf.queryExecution().optimizedPlan().toString(), None, 0
    for line in plan.splitlines():
        at = re.search(r"\w", line).start()
        depth = None if depth is not None and at <= depth else depth
        assert depth is None or not re.search(r"__tok|__ends", line)  # no converted tokens below the running sum, in either branch
        if depth is None and line[at:].startswith("Window ["):
            depth, windows = at, windows + 1
    assert windows == 4  # running sums and totals of ranges, in both branches
