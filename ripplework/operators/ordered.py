"""Operators on an order no task sees whole: as-of and interval joins, and shards cut by a token budget.

Rows are dealt into ranges of a total order, their number taken from a count, and work inside a range is followed by work
on one small row or table for each range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplework.operators.core import RANGE_ROWS, prefix_sum, ranges, require
from ripplework.session import materialize

def asof_join(left: DataFrame, right: DataFrame, on: str, by: tuple[str, ...] = (), tie: str | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """Left rows with `match`, the last right row (a struct) of the same `by` whose `on` is not later; null if none.

    Of right rows of equal `by` and `on` the one with the largest `tie` counts (without it, the largest row). Each distinct
    (by, on) is looked up once: the last match inside its range, else the last one of an earlier range, of which there is a
    row for each range and group. So neither a hot group nor a hot time is gathered. Null `by` or `on` has no match.
    """
    row = F.struct(*right.columns)
    keyed = " and ".join(f"`{c}` is not null" for c in (*by, on))
    kept = right.where(keyed).groupBy(*by, on).agg((F.max_by(row, tie) if tie else F.max(row)).alias("match"))
    asked = left.where(keyed).select(*by, on).distinct().withColumn("match", F.lit(None).cast(kept.schema["match"].dataType))
    both = kept.unionByName(asked).groupBy(*by, on).agg(F.first("match", ignorenulls=True).alias("match"))
    dealt = ranges(both, on, *by, rows=rows)
    inside = F.last("match", ignorenulls=True).over(W.partitionBy(*by, "__part").orderBy(on).rowsBetween(W.unboundedPreceding, 0))
    ends = dealt.where("match is not null").groupBy(*by, "__part").agg(F.max_by("match", on).alias("__end"))
    border = dealt.select(*by, "__part").distinct().join(ends, [*by, "__part"], "left")
    border = border.withColumn("__end", F.last("__end", ignorenulls=True).over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)))
    found = dealt.select(*by, on, "__part", inside.alias("match")).join(border, [*by, "__part"])
    found = found.select(*by, on, F.coalesce("match", "__end").alias("match"))
    return left.join(found, [*by, on], "left").select(*left.columns, "match")


def interval_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Left rows with `match`, each right row (a struct) of the same `by` with low <= at <= high.

    An interval goes to bins of the least power of two that is not shorter, so to two at most; a point goes to its bin
    at each of the sizes that occur. The join is then on equal bins, at least a quarter of whose width the interval covers,
    and adaptive execution splits a hot bin. Intervals of a single value meet by equality; empty ones and nulls never.
    """
    where = lambda c: F.col(c).cast("double")
    r = right.where(f"`{low}` <= `{high}`").select(*by, F.struct(*right.columns).alias("match"), where(low).alias("__low"), where(high).alias("__high"))
    r = r.withColumn("__level", F.when(F.col("__high") > F.col("__low"), F.ceil(F.log2(F.col("__high") - F.col("__low")))).cast("int"))
    size = F.pow(F.lit(2.0), F.coalesce("__level", F.lit(0)))
    first, last = F.col("__low") / size, F.col("__high") / size
    bins = F.when(F.col("__level").isNull(), F.array("__low")).otherwise(F.array_distinct(F.array(F.floor(first).cast("double"), F.floor(last).cast("double"))))
    r = materialize(r.withColumn("__bin", F.explode(bins)).withColumn("__level", F.coalesce("__level", F.lit(-10_000))).drop("__low", "__high"), "intervals")
    levels = sorted(x[0] for x in r.select("__level").distinct().collect())  # sizes of bins: two thousand exist
    to = [F.struct(F.lit(n).alias("__level"), (where(at) if n == -10_000 else F.floor(where(at) / F.lit(2.0**n)).cast("double")).alias("__bin")) for n in levels]
    empty = "array<struct<__level:int,__bin:double>>"
    points = left.withColumn("__to", F.explode(F.array(*to) if to else F.array().cast(empty))).select("*", "__to.*").drop("__to")
    j = points.join(r, [*by, "__level", "__bin"])
    return j.where((F.col(f"match.{low}") <= F.col(at)) & (F.col(at) <= F.col(f"match.{high}"))).select(*left.columns, "match")


def interval_sums(points: DataFrame, spans: DataFrame, at: str, value: str, low: str, high: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Spans with `n` and `total`, the number and sum of the points with low <= at <= high, for whole-number places.

    Running sums over the distinct places are looked up at both ends, so the work grows with points and spans, not with the
    pairs of them. Sums are of decimals, so they keep six
    places however long the order. Spans without a point and with nulls do not come out.
    """
    exact = F.coalesce(F.sum(F.col(value).cast("decimal(28,10)")), F.lit(0).cast("decimal(28,10)")).cast("decimal(28,10)")
    own = points.where(F.col(at).isNotNull()).groupBy(F.col(at).cast("bigint").alias("__at")).agg(F.count("*").alias("__n"), F.count(value).alias("__k"), exact.alias("__v"))
    sums = own
    for c, out in (("__n", "n"), ("__k", "k"), ("__v", "v")):
        sums = materialize(prefix_sum(sums, "__at", c, rows=rows, out="__b").withColumn(out, F.col("__b") + F.col(c)).drop("__b"), "sums")
    sums = materialize(sums.select("__at", "n", "k", "v"), "sums")
    x = spans.where(f"`{low}` <= `{high}`").withColumn("__high", F.col(high).cast("bigint")).withColumn("__low", F.col(low).cast("bigint") - 1)
    for end in ("__high", "__low"):
        x = asof_join(x.withColumnRenamed(end, "__at"), sums, "__at", rows=rows).drop("__at").withColumnRenamed("match", "_" + end)
    part = lambda c: F.coalesce(F.col(f"___high.{c}"), F.lit(0)) - F.coalesce(F.col(f"___low.{c}"), F.lit(0))
    return x.select(*spans.columns, part("n").alias("n"), F.when(part("k") > 0, part("v").cast("double")).alias("total")).where("n > 0")


# Shards by budget. A shard takes rows in order until the next one would exceed the budget; a row larger than the budget
# gets a shard of its own. Where a cut falls depends on the one before it, so the cuts are a chain. What a range does to
# the chain is a table: for the tokens still open when it begins (the first cut is the first row whose running sum exceeds
# what the budget leaves), how many cuts it makes and how many tokens it leaves open. Tables of neighbours compose, `fan`
# at a time, up to one for the whole; going down again each range learns what is open when it begins.

_TABLE = "node bigint, p bigint, cuts bigint, leave bigint, total bigint"
_INTO = "node bigint, open bigint, made bigint"


def _jumps(size: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, cuts, leave) of a range: by the running sum of the row where the first cut falls."""
    p = np.cumsum(size)
    n = len(p)
    after = np.maximum(np.searchsorted(p, p - size + budget, "right"), np.arange(n) + 1)
    last, cuts = np.where(after < n, np.minimum(after, n - 1), np.arange(n)), (after < n).astype(np.int64)
    while True:  # each step doubles the jumps
        further = last[last]
        if (further == last).all():
            break
        cuts, last = cuts + cuts[last], further
    first = np.searchsorted(p, np.unique(p[: np.searchsorted(p, budget, "right") + 1]), "left")
    return p[first], cuts[first] + 1, (p[-1] - (p - size)[last])[first]


def _compose(a: tuple, b: tuple, budget: int) -> tuple:
    """The table (p, cuts, leave, total) of a range followed by another."""
    (p, cuts, leave, total), (q, more, left, rest) = a, b
    at = np.searchsorted(q, budget - leave, "right")
    hit = at < len(q)
    to = np.minimum(at, len(q) - 1)
    cuts, leave = cuts + np.where(hit, more[to], 0), np.where(hit, left[to], leave + rest)
    if p[-1] <= budget:  # the first may make no cut
        far = int(np.searchsorted(q, budget - total, "right")) + 1
        tail = q[:far] + total > p[-1]
        p, cuts, leave = (np.concatenate([x, y[:far][tail]]) for x, y in ((p, q + total), (cuts, more), (leave, left)))
    return p, cuts, leave, total + rest


def _tables(pdf: pd.DataFrame):
    for node, t in pdf.sort_values(["node", "p"], kind="stable").groupby("node", sort=True):
        yield int(node), (t["p"].to_numpy(), t["cuts"].to_numpy(), t["leave"].to_numpy(), int(t["total"].iloc[0]))


def shards(df: DataFrame, order: str, size: str, budget: int, rows: int = RANGE_ROWS, fan: int = 32) -> DataFrame:
    """(shard, start, rows, tokens): what a writer makes that turns to a new shard when the row would exceed the budget.

    Rows are taken by `order`, which must be unique and not null; null sizes count 0, negative ones raise.
    """
    narrow = df.select(F.col(order).alias("start"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    narrow = require(narrow, (F.col("n") < 0) | F.col("start").isNull(), "sizes must not be negative, nor the order null")
    dealt = ranges(narrow, "start", rows=rows)

    def jumps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", kind="stable")
        p, cuts, leave = _jumps(pdf["n"].to_numpy(), budget)
        return pd.DataFrame({"node": int(pdf["__part"].iloc[0]), "p": p, "cuts": cuts, "leave": leave, "total": int(pdf["n"].sum())})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, node = None, int(pdf["node"].iloc[0]) // fan
        for _, t in _tables(pdf):
            whole = t if whole is None else _compose(whole, t, budget)
        p, cuts, leave, total = whole
        return pd.DataFrame({"node": node, "p": p, "cuts": cuts, "leave": leave, "total": total})

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        opened, made, out = int(pdf["open"].iloc[0]), int(pdf["made"].iloc[0]), []
        for node, (p, cuts, leave, total) in _tables(pdf):
            out.append((node, opened, made))
            at = int(np.searchsorted(p, budget - opened, "right"))
            opened, made = (int(leave[at]), made + int(cuts[at])) if at < len(p) else (opened + total, made)
        return pd.DataFrame(out, columns=["node", "open", "made"])

    levels = [materialize(dealt.groupBy("__part").applyInPandas(jumps, _TABLE), "jumps")]
    top = dealt.agg(F.max("__part")).first()[0] or 0
    while top:
        levels.append(materialize(levels[-1].groupBy(F.floor(F.col("node") / fan)).applyInPandas(compose, _TABLE), "jumps"))
        top //= fan
    into = df.sparkSession.createDataFrame([(0, budget + 1, 0)], _INTO)  # more than full, so that the first row opens a shard
    for level in reversed(levels[:-1]):
        parent = into.withColumnRenamed("node", "parent")
        children = level.withColumn("parent", F.floor(F.col("node") / fan)).join(parent, "parent")
        into = materialize(children.groupBy("parent").applyInPandas(descend, _INTO), "open")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", kind="stable")
        n, keys = pdf["n"].to_numpy(), pdf["start"].to_numpy()
        p = np.cumsum(n)
        at, cuts = int(np.searchsorted(p, budget - int(pdf["open"].iloc[0]), "right")), []
        while at < len(p):
            cuts.append(at)
            at = max(at + 1, int(np.searchsorted(p, p[at] - n[at] + budget, "right")))
        edge = np.array([0, *cuts, len(p)])
        sums = np.concatenate([[0], p])
        shard = int(pdf["made"].iloc[0]) - 1 + np.arange(len(edge) - 1)
        out = pd.DataFrame({"shard": shard, "start": [None, *keys[cuts]], "rows": np.diff(edge), "tokens": np.diff(sums[edge])})
        return out[(out["rows"] > 0)]

    kind = df.schema[order].dataType.simpleString()
    parts = dealt.join(into, dealt["__part"] == into["node"]).drop("node")
    made = parts.groupBy("__part").applyInPandas(cut, f"shard bigint, start {kind}, rows bigint, tokens bigint")
    return made.groupBy("shard").agg(F.max("start").alias("start"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))


def with_shard(df: DataFrame, order: str, size: str, budget: int, rows: int = RANGE_ROWS) -> DataFrame:
    """Adds `shard` to every row: the last shard that starts at or before it."""
    starts = materialize(shards(df, order, size, budget, rows), "shards").select(F.col("start").alias(order), "shard")
    return asof_join(df, starts, order, rows=rows).withColumn("shard", F.col("match.shard")).drop("match")
