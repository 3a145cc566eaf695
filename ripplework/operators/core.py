"""Relational operators: pairs, rankings, paired comparison, statistics, ordered series, corpus building, checks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplework.functions import text as T
from ripplework.session import materialize


def rate(flag: Column) -> Column:
    """Share of true rows; 0.0 for none."""
    return F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("double")), F.lit(0.0))


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed with a prefix, but for the kept ones."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """The frame, raising at run time on a row where `bad` holds."""
    return df.where(F.assert_true(~F.coalesce(bad, F.lit(False)), message).isNull())


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that occur more than once: empty if all is well."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def join_equal_keys(a: DataFrame, b: DataFrame, key: str | list[str]) -> DataFrame:
    """1:1 join that raises if either side has a key the other lacks."""
    j = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), key, "full_outer")
    return require(j, F.col("__a").isNull() | F.col("__b").isNull(), "key sets differ").drop("__a", "__b")


def last_wins(df: DataFrame, key: str, pos: str) -> DataFrame:
    """One row for each key, the last by position."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), pos).alias("__r")).select("__r.*")


def first_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One row for each key, the first by position."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), pos).alias("__r")).select("__r.*")


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: eight for a number, and what arrays and texts hold."""
    of = lambda c, kind: 16 + 8 * F.coalesce(F.size(c), F.lit(0)) if kind.startswith("array") else 16 + F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8 if not kind.startswith(("struct", "map")) else 64)
    return reduce(lambda x, y: x + y, [of(F.col(f"`{c}`"), kind) for c, kind in df.dtypes])


def cross_pairs(left: DataFrame, right: DataFrame, rows: int = 20_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Every row of a stated query set against every candidate.

    The query set is counted and measured: up to `rows` rows and `most_bytes` it is broadcast, beyond that it is dealt into
    blocks of about that size, and a candidate goes to every block.
    """
    got = left.agg(F.count("*").alias("n"), F.sum(_row_bytes(left)).alias("b")).first()
    blocks = max(-(-got["n"] // rows), -(-int(got["b"] or 0) // most_bytes))
    if blocks <= 1:
        return right.crossJoin(F.broadcast(left))
    q = left.withColumn("__block", F.pmod(F.xxhash64(*left.columns), F.lit(blocks)).cast("int"))
    c = right.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return c.join(q, "__block").drop("__block")


def record_pairs(df: DataFrame, i: str = "i", directed: bool = False, include_self: bool = False) -> DataFrame:
    """Pairs of one table by index: i < j, i <= j or all."""
    a, b = prefixed(df, "left_"), prefixed(df, "right_")
    x, y = F.col("left_" + i), F.col("right_" + i)
    on = (F.lit(True) if include_self else x != y) if directed else (x <= y if include_self else x < y)
    return a.join(b, on)


def top_k(df: DataFrame, query: str, score: str, candidate: str, k: int) -> DataFrame:
    """The k best candidates of each query, ties to the higher index; rank from 1."""
    w = W.partitionBy(query).orderBy(F.col(score).desc(), F.col(candidate).desc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def average_rank(x: str, *by: str) -> Column:
    """Rank where ties share their mean rank."""
    return F.rank().over(W.partitionBy(*by).orderBy(x)) + (F.count("*").over(W.partitionBy(*by, x)) - 1) / F.lit(2.0)


def with_average_rank(df: DataFrame, x: str, by: tuple[str, ...], out: str) -> DataFrame:
    """Adds the average rank of x in its group from counts of values: no task sorts a whole group."""
    counts = materialize(df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("__c")), "values")
    n = prefix_sum(counts, x, "__c", by, out="__b")
    n = n.select(*by, x, (F.col("__b") + (F.col("__c") + 1) / F.lit(2.0)).alias(out))
    return df.join(n, [*by, x], "left")


def auc_recall(scores: DataFrame, query: str, score: str, candidate: str, positive: str, cells: int | None = None) -> DataFrame:
    """(query, auc, recall): one-vs-rest ROC AUC from average ranks, and the share of positives among the top n, n their number.

    Candidates and positives are counted by query and score; ranges of the score, shared by all queries, are summed, and a
    score's place is what lies in lower ranges and what lies below it in its own, so no task sorts a query's candidates.
    Recall takes all scores above the one where the n-th place falls; of that one it takes the last candidates (X07, X08).
    """
    y = F.col(positive)
    tied = materialize(scores.groupBy(query, score).agg(F.count("*").alias("__n"), F.count_if(y).alias("__p")), "scores")
    tied = tied.withColumn("__cell", _cell(tied, score, cells))
    totals = tied.groupBy(query, "__cell").agg(F.sum("__n").alias("__cn"), F.sum("__p").alias("__cp"))
    every, ahead = W.partitionBy(query), W.partitionBy(query).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    totals = totals.select(query, "__cell", F.coalesce(F.sum("__cn").over(ahead), F.lit(0)).alias("__low"), F.sum("__cn").over(every).alias("__all"), F.sum("__cp").over(every).alias("__pos"))
    inside = F.sum("__n").over(W.partitionBy(query, "__cell").orderBy(score).rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    r = _joined(tied.withColumn("__in", inside), totals, [query, "__cell"]).withColumn("__below", F.col("__low") + F.col("__in"))
    r = r.withColumn("__above", F.col("__all") - F.col("__below") - F.col("__n"))
    p, n = F.max("__pos"), F.max("__all")
    area = (F.sum(F.col("__p") * (F.col("__below") + (F.col("__n") + 1) / F.lit(2.0))) - p * (p + 1) / F.lit(2.0)) / F.nullif((p * (n - p)).cast("double"), F.lit(0.0))
    whole = F.coalesce(F.sum(F.when(F.col("__above") + F.col("__n") <= F.col("__pos"), F.col("__p"))), F.lit(0))
    out = r.groupBy(query).agg(area.alias("auc"), whole.alias("__whole"), F.max("__pos").alias("__pos"))
    edge = r.where("__above < __pos and __above + __n > __pos").select(F.col(query).alias("__q"), F.col(score).alias("__s"), (F.col("__pos") - F.col("__above")).alias("__take"))
    part = scores.join(edge, scores[query].eqNullSafe(edge["__q"]) & scores[score].eqNullSafe(edge["__s"]))
    part = part.withColumn("__i", F.row_number().over(W.partitionBy(query).orderBy(F.col(candidate).desc()))).where("__i <= __take")
    part = part.groupBy(F.col(query).alias("__q")).agg(F.count_if(y).alias("__part"))
    out = out.join(part, out[query].eqNullSafe(part["__q"]), "left")
    return out.select(query, "auc", ((F.col("__whole") + F.coalesce("__part", F.lit(0))) / F.nullif(F.col("__pos"), F.lit(0))).alias("recall"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r; null if a side is constant."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def sign_agreement(x: Column, y: Column, eps: float = 0.0) -> Column:
    """Share of equal signs among pairs that are not zero."""
    return F.avg(F.when((F.abs(x) > eps) & (F.abs(y) > eps), (F.signum(x) == F.signum(y)).cast("double")))


def origin_slope(x: Column, y: Column) -> Column:
    """Least-squares slope through the origin."""
    return F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))


def distribution(x: Column) -> list[Column]:
    """Mean, median, p90, p95, p99 (linear), max."""
    q = F.percentile(x, F.array(*[F.lit(v) for v in (0.5, 0.9, 0.95, 0.99)]))
    return [F.avg(x).alias("mean"), *[F.get(q, F.lit(i)).alias(n) for i, n in enumerate(("median", "p90", "p95", "p99"))], F.max(x).alias("max")]


def histogram(df: DataFrame, by: str, x: str, bins: int) -> DataFrame:
    """(by, bin, n): equal-width bins from least to largest value of each group, the last one closed, empty ones with 0 (X11).

    A group of one value has one bin; nulls are not counted, a group of nulls has no bins.
    """
    b = df.where(F.col(x).isNotNull()).groupBy(by).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi")).withColumnRenamed(by, "__g")
    place = F.least(F.floor((F.col(x) - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / bins)), F.lit(bins - 1).cast("bigint"))
    place = F.when(F.col("__hi") > F.col("__lo"), place).otherwise(F.lit(0).cast("bigint"))
    n = df.where(F.col(x).isNotNull()).join(b, df[by].eqNullSafe(b["__g"])).groupBy(F.col(by).alias("__h"), place.alias("__b")).agg(F.count("*").alias("n"))
    every = b.select(F.col("__g").alias(by), F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("__hi") > F.col("__lo"), F.lit(bins - 1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))).alias("bin"))
    return every.join(n, every[by].eqNullSafe(n["__h"]) & (F.col("bin") == F.col("__b")), "left").select(by, "bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def floor_percentile(df: DataFrame, by: str, x: str, q: float, out: str) -> DataFrame:
    """(by, out): the value at place floor(q (n - 1)) of each sorted group, from counts of values."""
    c = df.where(F.col(x).isNotNull()).groupBy(by, x).agg(F.count("*").alias("__c"))
    n = c.groupBy(by).agg(F.sum("__c").alias("__n")).withColumnRenamed(by, "__g")
    c = prefix_sum(c, x, "__c", (by,), out="__b").join(n, F.col(by).eqNullSafe(F.col("__g")))
    place = F.floor(F.lit(q) * (F.col("__n") - 1))
    return c.where((F.col("__b") <= place) & (place < F.col("__b") + F.col("__c"))).select(by, F.col(x).alias(out))


def _with_halo(df: DataFrame, series: str, x: str, halo: int, rows: int) -> DataFrame:
    """Adds __cell and __own: runs of `rows` rows of each series, each with copies of `halo` rows from either side."""
    one = df.withColumn("__one", F.lit(1).cast("bigint"))
    at = prefix_sum(one, x, "__one", (series,), out="__i").drop("__one")
    cell, place = F.floor(F.col("__i") / rows), F.col("__i") % rows
    cells = F.array(cell, F.when((place < halo) & (cell > 0), cell - 1), F.when(place >= rows - halo, cell + 1))
    at = at.withColumn("__home", cell).withColumn("__cell", F.explode(F.array_compact(cells)))
    return at.withColumn("__own", F.col("__cell") == F.col("__home")).drop("__i", "__home")


def rolling_mad(df: DataFrame, series: str, x: str, y: str, window: int = 9, n_sigma: float = 3.0, rows: int = 50_000) -> DataFrame:
    """Adds med, mad and outlier: centred rolling median, and whether a point is n sigma off it.

    Series are cut into runs of `rows` rows that overlap by two half windows, so a long one is dealt to many tasks.
    """
    h = window // 2
    df = _with_halo(df, series, x, 2 * h, max(rows, 4 * h + 1))
    w = W.partitionBy(series, "__cell").orderBy(x).rowsBetween(-h, h)
    df = df.withColumn("med", F.percentile(y, F.lit(0.5)).over(w)).withColumn("__d", F.abs(F.col(y) - F.col("med")))
    df = df.withColumn("mad", F.percentile("__d", F.lit(0.5)).over(w))
    sigma = F.col("mad") * 1.4826
    return df.where("__own").withColumn("outlier", (sigma > 1e-8) & (F.col("__d") > n_sigma * sigma)).drop("__d", "__own", "__cell")


def _joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where null meets null; the other side's keys go."""
    named = other.withColumnsRenamed({k: "__j_" + k for k in keys})
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(named["__j_" + k]) for k in keys])
    return df.join(named, on).drop(*["__j_" + k for k in keys])


#: Rows of an ordered range on average, and the most ranges that are told apart by literals.
RANGE_ROWS, CELLS = 1_000_000, 256


def _counted_cell(df: DataFrame, order: str, cells: int | None = None, rows: int = RANGE_ROWS) -> tuple[int, Column]:
    """(number of rows, which ordered range of about equal numbers of rows a row falls into); null falls into the first.

    As many ranges as the count of rows asks for, CELLS at most; or `cells`.
    """
    most = cells or CELLS
    got = df.agg(F.count("*").alias("n"), F.percentile_approx(order, F.array(*[F.lit(i / most) for i in range(1, most)] or [F.lit(0.5)]), 10_000).alias("q")).first()
    keep = cells or min(CELLS, max(1, -(-got["n"] // rows)))
    q = got["q"] or []
    cuts = sorted({q[i * most // keep - 1] for i in range(1, keep)} if q else ())
    return got["n"], F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)


def _cell(df: DataFrame, order: str, cells: int | None = None) -> Column:
    return _counted_cell(df, order, cells)[1]


def ranges(df: DataFrame, *order: str, rows: int = RANGE_ROWS) -> DataFrame:
    """The rows, written, with `__part`: ranges of the order of at most about `rows` rows, numbered in that order.

    Only rows that are equal in all of `order` must share a range, so name columns that tell rows apart.
    """
    df = materialize(df, "unordered")
    parts = max(1, -(-df.count() // rows))
    return materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id().cast("bigint")), "ranges")


def interpolate(df: DataFrame, series: str, x: str, y: str, cells: int | None = None) -> DataFrame:
    """Nulls of y filled on the line between their neighbours by row; ends take the nearest.

    Neighbours are looked for inside ordered ranges first, then among the ranges' ends, a row for each range.
    """
    df = prefix_sum(df.withColumn("__one", F.lit(1).cast("bigint")), x, "__one", (series,), out="__i").drop("__one")
    df = df.withColumn("__cell", _cell(df, x, cells))
    at, has = F.struct(F.col("__i").alias("i"), F.col(y).alias("v")), F.col(y).isNotNull()
    ends = df.groupBy(series, "__cell").agg(F.max_by(at, F.when(has, F.col("__i"))).alias("l"), F.min_by(at, F.when(has, F.col("__i"))).alias("f"))
    ahead, back = (W.partitionBy(series).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.col("__cell"), F.col("__cell").desc()))
    ends = ends.select(series, "__cell", F.last("l", True).over(ahead).alias("__l"), F.last("f", True).over(back).alias("__f"))
    # both ways as running windows: a frame up to the last row is gone through again for each row
    up, down = (W.partitionBy(series, "__cell").orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.col("__i"), F.col("__i").desc()))
    mark = F.when(has, at)
    df = df.withColumn("__p", F.last(mark, True).over(up)).withColumn("__n", F.last(mark, True).over(down))
    df = _joined(df, ends, [series, "__cell"]).withColumn("__p", F.coalesce("__p", "__l")).withColumn("__n", F.coalesce("__n", "__f"))
    gap = F.col("__n.i") - F.col("__p.i")
    line = F.when(gap > 0, F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * (F.col("__i") - F.col("__p.i")) / gap).otherwise(F.col("__p.v"))
    return df.withColumn(y, F.coalesce(F.col(y), line, F.col("__p.v"), F.col("__n.v"))).drop("__i", "__p", "__n", "__l", "__f", "__cell")


def _fold(v: np.ndarray, decay: float, width: int = 128) -> np.ndarray:
    """r_t = decay r_t-1 + v_t: rows of `width` places at once by powers of the decay, then from row to row."""
    rows = np.concatenate([v, np.zeros(-len(v) % width)]).reshape(-1, width)
    back = np.arange(width)[:, None] - np.arange(width)
    r = rows @ np.where(back >= 0, float(decay) ** np.maximum(back, 0), 0.0).T
    ahead, into = float(decay) ** np.arange(1, width + 1), 0.0
    for row in r:
        row += into * ahead
        into = row[-1]
    return r.ravel()[: len(v)]


def recurrence(df: DataFrame, series: str, x: str, u: str, decay: float, out: str, start: str | None = None, cells: int | None = None) -> DataFrame:
    """Adds r_t = decay r_t-1 + u_t along x in each series, from 0 or from the column `start` (one value a series).

    Two phases, as in prefix_sum: ordered ranges are folded one by one, then the ranges' ends are, a row for each range,
    and each range's rows take decay^k of what came in. Null u counts as 0; equal x are taken in any order.
    """
    df = df.withColumn("__cell", _cell(df, x, cells)).withColumn("__k", F.lit(0).cast("bigint")).withColumn("__r", F.lit(0.0))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x, kind="stable")
        return pdf.assign(__k=np.arange(1, len(pdf) + 1), __r=_fold(pdf[u].astype(float).fillna(0.0).to_numpy(), decay))

    done = materialize(df.groupBy(series, "__cell").applyInPandas(fold, df.schema), "recurrence")
    first = F.min(start).cast("double") if start else F.lit(0.0)
    ends = done.groupBy(series, "__cell").agg(F.max("__k").alias("__en"), F.max_by("__r", "__k").alias("__er"), first.alias("__es"))
    carry = lambda a, e: F.struct((F.pow(F.lit(decay), e["__en"]) * a["v"] + e["__er"]).alias("v"), F.concat(a["out"], F.array(F.struct(e["__cell"].alias("__cell"), a["v"].alias("__v")))).alias("out"))
    zero = F.struct(F.coalesce("__es", F.lit(0.0)).alias("v"), F.array().cast("array<struct<__cell:int,__v:double>>").alias("out"))
    into = ends.groupBy(series).agg(F.array_sort(F.collect_list(F.struct("__cell", "__en", "__er"))).alias("__e"), F.min("__es").alias("__es"))  # `cells` entries
    into = into.select(series, F.inline(F.aggregate("__e", zero, carry)["out"]))
    rows = _joined(done, into, [series, "__cell"])
    return rows.withColumn(out, F.col("__r") + F.pow(F.lit(decay), F.col("__k")) * F.col("__v")).drop("__cell", "__k", "__r", "__v")


def ema(df: DataFrame, series: str, x: str, y: str, alpha: float, out: str = "ema") -> DataFrame:
    """y0 = x0, yt = alpha xt + (1 - alpha) yt-1, whatever the length of a series."""
    first = df.groupBy(series).agg(F.min_by(y, x).cast("double").alias("__y0")).withColumnRenamed(series, "__g")
    rows = df.join(first, df[series].eqNullSafe(first["__g"])).drop("__g").withColumn("__u", F.col(y).cast("double") * F.lit(alpha))
    return recurrence(rows, series, x, "__u", 1 - alpha, out, "__y0").drop("__u", "__y0")


def decayed_mean(df: DataFrame, series: str, x: str, y: str, decay: float, out: str) -> DataFrame:
    """Adds the mean of all earlier y, each weighted decay^(steps back); the first row of a series has none."""
    rows = recurrence(df.withColumn("__one", F.lit(1.0)), series, x, y, decay, "__sum")
    rows = recurrence(rows, series, x, "__one", decay, "__all").withColumn("__v", F.col(y).cast("double"))
    # what came before: the sums less this row's own part; the decay they share cancels
    before = (F.col("__sum") - F.coalesce("__v", F.lit(0.0))) / F.nullif(F.col("__all") - 1, F.lit(0.0))
    return rows.withColumn(out, before).drop("__one", "__sum", "__all", "__v")


def prefix_sum(df: DataFrame, order: str, value: str, by: tuple[str, ...] = (), rows: int = RANGE_ROWS, out: str = "before", tell: bool = False) -> DataFrame:
    """Adds the sum of `value` over the rows ahead in `order`: totals of ordered ranges, then inside them.
    To `tell` keeps a row's range, what is ahead of it and its total (__cell, __s, __t), rows dealt by range.

    Ranges hold about `rows` rows, so their number grows with the input. Up to CELLS ranges are cut at literals; beyond, rows
    are dealt into ranges and written, and if the totals (a row for each range and group) are more than `rows` again, they
    are summed in the same way, level upon level. No task sees more than one range.
    """
    n, cell = _counted_cell(df, order, rows=rows)
    deep = n > CELLS * rows
    df = ranges(df, order, *by, rows=rows).withColumnRenamed("__part", "__cell") if deep else df.withColumn("__cell", cell)
    totals = df.groupBy(*by, "__cell").agg(F.sum(value).alias("__t"))
    if deep and rows < (totals := materialize(totals, "totals")).count() < n // 2:
        starts = prefix_sum(totals.withColumnRenamed("__cell", "__place"), "__place", "__t", by, rows, "__sum").withColumnsRenamed({"__place": "__cell", "__sum": "__s"})
    else:
        starts = totals.withColumn("__s", F.sum("__t").over(W.partitionBy(*by).orderBy("__cell")) - F.col("__t"))
    if tell:
        df = df.repartition(max(1, -(-n // rows)), "__cell")
        starts = starts if deep or by else F.broadcast(starts)  # CELLS rows at most
    inside = F.sum(value).over(W.partitionBy(*by, "__cell").orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    return _joined(df.withColumn("__l", inside), starts, [*by, "__cell"]).withColumn(out, F.col("__l") + F.coalesce("__s", F.lit(0))).drop("__l", *(() if tell else ("__cell", "__s", "__t")))


def _cut(rows: DataFrame, by: tuple[str, ...], length: int, *carry: str, where: Column | None = None, tokens: str = "__tok") -> DataFrame:
    """(by, chunk_index, token_ids, carry's lo and hi): arrays of `tokens` that start at `__at` of a stream, cut every `length`;
    all chunks, or those of rows `where` it holds of the row and its chunk_index.

    A piece of each chunk a row reaches is dealt out, not a row for each token.
    """
    first, last = F.floor(F.col("__at") / length), F.floor((F.col("__at") + F.size(tokens) - 1) / length)
    pieces = rows.select("*", F.explode(F.sequence(first, last)).alias("chunk_index"))
    pieces = (pieces if where is None else pieces.where(where)).select(*by, *carry, "__at", tokens, "chunk_index")
    begin = F.greatest(F.col("chunk_index") * length, F.col("__at"))
    take = F.slice(tokens, (begin - F.col("__at") + 1).cast("int"), ((F.col("chunk_index") + 1) * length - begin).cast("int"))
    packed = pieces.select(*by, "chunk_index", *carry, begin.alias("__o"), take.alias("__t")).groupBy(*by, "chunk_index")
    packed = packed.agg(F.array_sort(F.collect_list(F.struct("__o", "__t"))).alias("__r"), *[f(c).alias(f"{c}_{n}") for c in carry for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return packed.withColumn("token_ids", F.flatten(F.transform("__r", lambda r: r["__t"]))).drop("__r")


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds places from 0 in order of a key of any type: ranges are dealt to tasks and counted, then numbered inside."""
    rows = materialize(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranges")
    n = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    n = n.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__b"))  # a row for each range
    inside = F.row_number().over(W.partitionBy("__part").orderBy(key)) - 1
    return rows.withColumn("__i", inside).join(F.broadcast(n), "__part").withColumn(out, F.col("__b") + F.col("__i")).drop("__part", "__i", "__b")


def top_support(counts: DataFrame, task: str, token: str, n: str, k: int) -> DataFrame:
    """The k most frequent tokens of each task, ties by token."""
    w = W.partitionBy(task).orderBy(F.col(n).desc(), token)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pack_chunks(docs: DataFrame, order: str, tokens: str, length: int, by: tuple[str, ...] = (), eos: str | None = None, budget: int | None = None) -> DataFrame:
    """(by, chunk_index, token_ids): documents' tokens joined by `eos`, cut every `length`; a shorter tail is dropped.

    A budget of tokens for each group is cut down to whole chunks; rows beyond it are not cut at all.
    """
    d = docs.withColumn("__tok", F.concat(tokens, F.array(F.lit(eos))) if eos is not None else F.col(tokens))
    d = prefix_sum(d.withColumn("__n", F.size("__tok").cast("bigint")), order, "__n", by, out="__at").where("__n > 0")
    if budget is not None:
        d = d.where(F.col("__at") < budget // length * length)
    whole = F.size("token_ids") == length
    if budget is not None:
        whole = whole & (F.col("chunk_index") < budget // length)
    return _cut(d, by, length).where(whole).select(*by, "chunk_index", "token_ids")


def approximate_score(one: DataFrame, other: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """(a, b, score): for pairs of groups, the dot of their summed first vectors times that of their summed second ones.

    Both are sparse rows (group, index, value), summed before they meet.
    """

    def dots(v: DataFrame, out: str) -> DataFrame:
        v = v.groupBy(group, index).agg(F.sum(value).alias("x"))
        l, r = (v.select(F.col(group).alias(n), index, F.col("x").alias("x" + n)) for n in "ab")
        return l.join(r, index).groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias(out))

    return dots(one, "__h").join(dots(other, "__e"), ["a", "b"]).select("a", "b", (F.col("__h") * F.col("__e")).alias("score"))


def hash_order(seed, *parts: Column) -> Column:
    """An order that looks random, is the same everywhere and in SQL: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def sample_per_group(df: DataFrame, group: str, key: str, k: int, seed) -> DataFrame:
    """k rows of each group without replacement."""
    w = W.partitionBy(group).orderBy(hash_order(seed, F.col(key)), key)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def shuffle_take(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    """n rows in hash order."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text", drop: bool = False) -> DataFrame:
    """Adds `contaminated` (or drops): the normalised text equals a benchmark text."""
    known = bench.select(T.fingerprint(F.col(text)).alias("__h")).distinct().withColumn("contaminated", F.lit(True))
    d = docs.withColumn("__h", T.fingerprint(F.col(text)))
    if drop:
        return d.join(known, "__h", "left_anti").drop("__h")
    return d.join(known, "__h", "left").withColumn("contaminated", F.coalesce("contaminated", F.lit(False))).drop("__h")


def resume(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet."""
    return new.join(done.select(key).distinct(), key, "left_anti")


def effective_rank(df: DataFrame, group: str, vector: str, fan: int = 8, rows: int = 4096) -> DataFrame:
    """(group, trace, lambda_min, lambda_max, effective_rank) of the Gram matrix of each group's vectors.

    Tall-skinny QR: up to `rows` vectors of a group are reduced where they are read to a triangle of d rows with the same
    singular values, triangles are reduced `fan` at a time in rounds until a group has one, and its singular values squared
    are the eigenvalues, without the loss of squaring first. A task holds `fan` triangles of d x d, never a group. With more
    vectors than entries the least eigenvalue is 0. The effective rank is exp of the entropy of the eigenvalues' shares
    above 1e-12; 0 for vectors that are all zero. Null vectors are left out.
    """
    kind = df.schema[group].dataType.simpleString()
    schema = f"`{group}` {kind}, n bigint, d int, node bigint, r array<double>"
    columns = [group, "n", "d", "node", "r"]

    def triangle(m: np.ndarray) -> np.ndarray:
        return np.linalg.qr(m, "r") if len(m) > m.shape[1] else m

    def reduce_read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            for g, v in f.groupby(group, dropna=False)[vector]:
                x = np.stack(list(v)).astype(float)
                for at in range(0, len(x), rows):
                    part = x[at : at + rows]
                    n, before = held.get(g, (0, part[:0]))
                    held[g] = n + len(part), triangle(np.concatenate([before, part]))
            if sum(m.size for _, m in held.values()) > 8_000_000:
                yield pd.DataFrame([(g, n, m.shape[1], 0, m.ravel()) for g, (n, m) in held.items()], columns=columns)
                held.clear()
        yield pd.DataFrame([(g, n, m.shape[1], 0, m.ravel()) for g, (n, m) in held.items()], columns=columns)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        m = triangle(np.concatenate([np.reshape(r, (-1, d)) for r in pdf["r"]]))
        return pd.DataFrame([(pdf[group].iloc[0], int(pdf["n"].sum()), d, int(pdf["__to"].iloc[0]), m.ravel())], columns=columns)

    read = df.select(group, F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull())
    level = materialize(read.mapInPandas(reduce_read, schema).withColumn("node", F.monotonically_increasing_id()), "triangles")
    while True:
        many = level.groupBy(group).count().agg(F.max("count")).first()[0] or 1
        if many == 1:
            break
        to = F.pmod(F.xxhash64("node"), F.lit(-(-many // fan))) if many > fan else F.lit(0).cast("bigint")
        level = materialize(level.withColumn("__to", to).groupBy(group, "__to").applyInPandas(merge, schema).withColumn("node", F.monotonically_increasing_id()), "triangles")

    def spectrum(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g, n, d, r in zip(f[group], f["n"], f["d"], f["r"], strict=True):
                lam = np.linalg.svd(np.reshape(r, (-1, d)), compute_uv=False) ** 2
                total = float(lam.sum())
                p = lam / total if total > 0 else lam[:0]
                p = p[p > 1e-12]
                out.append((g, total, float(lam[-1]) if n <= len(lam) else 0.0, float(lam[0]), float(np.exp(-(p * np.log(p)).sum())) if len(p) else 0.0))
            yield pd.DataFrame(out, columns=[group, "trace", "lambda_min", "lambda_max", "effective_rank"])

    return level.mapInPandas(spectrum, f"`{group}` {kind}, trace double, lambda_min double, lambda_max double, effective_rank double")


def _poisson(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """len(keys) x draws weights, Poisson(1) of a hash of key, draw and seed."""
    h = keys.astype(np.int64).view(np.uint64)[:, None] + (np.arange(draws, dtype=np.uint64) + np.uint64(seed << 32) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = (h ^ (h >> np.uint64(31))) / 2.0**64
    cuts = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(10)])
    return np.searchsorted(cuts, u, side="right").astype(float)


def cluster_bootstrap(matrix: DataFrame, row: str, col: str, value: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """(mean, lo, hi): two-way cluster bootstrap of a matrix mean, rows and columns drawn anew, 95 % interval.

    A row's (and a column's) count in a draw is Poisson(1) of a hash of its key and the draw, so that no ids need be
    numbered or joined: each task sums its cells for all draws at once and hands on `draws` rows. Null cells are left out.
    """

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, below = np.zeros(draws), np.zeros(draws)
        for f in frames:
            for at in range(0, len(f), 4096):
                r, c, v = (f[x].to_numpy()[at : at + 4096] for x in ("r", "c", "v"))
                w = _poisson(r, draws, seed) * _poisson(c, draws, seed + 1)
                top, below = top + v @ w, below + w.sum(0)
        yield pd.DataFrame({"b": np.arange(draws), "top": top, "below": below})

    cells = matrix.select(F.xxhash64(row).alias("r"), F.xxhash64(col).alias("c"), F.col(value).cast("double").alias("v")).where("v is not null")
    return bootstrap_interval(cells.mapInPandas(sums, "b int, top double, below double"))


def bootstrap_interval(sums: DataFrame) -> DataFrame:
    """(mean, lo, hi) from rows (b, top, below): parts of the weighted sums and weights of each draw."""
    drawn = sums.groupBy("b").agg(F.sum("top").alias("top"), F.sum("below").alias("below"))
    means = drawn.where("below > 0").select((F.col("top") / F.col("below")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(F.avg("m").alias("mean"), F.get(q, F.lit(0)).alias("lo"), F.get(q, F.lit(1)).alias("hi"))


def bootstrap_line(df: DataFrame, group: str, key: str, x: str, y: str, grid: list[float], log: bool = False, draws: int = 200, seed: int = 0) -> DataFrame:
    """(group, x, fit, lo, hi): least-squares line of each group over a grid and its 95 % bootstrap band.

    Row weights of a draw are Poisson(1) of a hash of draw and key, so a draw is a weighted sum: six sums for each draw,
    taken in one pass with partial aggregation; rows never multiply beyond the draws. With `log`, both axes are logarithms
    and rows that are not positive are left out. Nulls are left out; a draw without spread in x gives no line. The fit is
    draw -1, every row once.
    """
    at = (lambda c: F.log(c)) if log else (lambda c: c)
    rows = df.where(f"`{x}` is not null and `{y}` is not null" + (f" and `{x}` > 0 and `{y}` > 0" if log else ""))
    rows = rows.select(group, F.col(key).alias("__k"), at(F.col(x)).alias("__x"), at(F.col(y)).alias("__y"))
    rows = rows.withColumn("__b", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))))
    u = F.pmod(F.xxhash64("__b", "__k", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    cuts, p, c = [], math.exp(-1), 0.0
    for i in range(10):
        c += p
        cuts.append(c)
        p /= i + 1
    weight = F.when(F.col("__b") < 0, 1).otherwise(sum((F.when(u >= q, 1).otherwise(0) for q in cuts), F.lit(0)))
    w = rows.withColumn("__w", weight.cast("double")).where("__w > 0").groupBy(group, "__b")
    s = w.agg(*[F.sum(e).alias(n) for n, e in (("n", F.col("__w")), ("sx", F.expr("__w * __x")), ("sy", F.expr("__w * __y")), ("sxx", F.expr("__w * __x * __x")), ("sxy", F.expr("__w * __x * __y")))])
    s = s.withColumn("slope", F.expr("(n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0D)")).withColumn("start", F.expr("(sy - slope * sx) / n")).where("slope is not null")
    lines = s.select(group, "__b", "slope", "start", F.explode(F.array(*map(F.lit, grid))).alias("x"))
    v = F.col("start") + F.col("slope") * at(F.col("x"))
    lines = lines.withColumn("v", F.exp(v) if log else v)
    q = F.percentile(F.when(F.col("__b") >= 0, F.col("v")), F.array(F.lit(0.025), F.lit(0.975)))
    return lines.groupBy(group, "x").agg(F.max(F.when(F.col("__b") < 0, F.col("v"))).alias("fit"), F.get(q, F.lit(0)).alias("lo"), F.get(q, F.lit(1)).alias("hi"))


#: Rows of a range of documents at least: what a task sorts and cuts at a time.
RANGE_DOCS = 4096


def retokenise(docs: DataFrame, order: str, tokens: str | Column, source: str, convert: Callable[[Column], Column], length: int, eos: str) -> DataFrame:
    """(chunk_index, token_ids, label): segments of a packed stream in another vocabulary, packed anew.

    A segment is what stands between two `eos`; `convert` gives its tokens in the other vocabulary. A chunk's label is its
    source, or `mixed` if it holds several. Segments are the documents, so they are converted before the stream is laid
    out: no running count of `eos` over the corpus is needed. The frame is dealt once, by ranges of the order, as it is
    (tokens made from a column by a Column are made after); chunks inside a range are put together where it lies, and only
    the pieces of those across two ranges are dealt again.
    """
    words = F.col(tokens) if isinstance(tokens, str) else tokens
    converted = F.concat(convert(words), F.array(F.lit(eos)))
    rows = min(RANGE_ROWS, max(RANGE_DOCS, -(-docs.count() // CELLS)))
    d = prefix_sum(docs.withColumn("__n", F.size(converted).cast("bigint")), order, "__n", rows=rows, out="__at", tell=True)
    end = F.col("__s") + F.col("__t")
    k = F.col("chunk_index")
    inside = (k * length >= F.col("__s")) & ((k + 1) * length <= end)
    edge = (F.col("__at") < F.ceil(F.col("__s") / length) * length) | (F.col("__at") + F.col("__n") > F.floor(end / length) * length)
    made = lambda d, name: d.select(source, "__at", "__cell", "__s", "__t", converted.alias(name))
    whole = _cut(made(d, "__tok"), ("__cell",), length, source, where=inside).drop("__cell")
    across = _cut(made(d.where(edge), "__ends"), (), length, source, where=~inside, tokens="__ends")
    out = whole.unionByName(across).where(F.size("token_ids") == length)
    return out.select("chunk_index", "token_ids", F.when(F.col(f"{source}_lo") == F.col(f"{source}_hi"), F.col(f"{source}_lo")).otherwise("mixed").alias("label"))


def t_test_p(df: DataFrame, r: str, n: str, out: str = "p_value") -> DataFrame:
    """Two-sided p of a correlation by the t distribution, by the continued fraction of the incomplete beta function."""
    @F.pandas_udf("double")
    def p(r_: pd.Series, n_: pd.Series) -> pd.Series:
        return pd.Series([_beta_p(a, b) for a, b in zip(r_, n_, strict=True)])

    return df.withColumn(out, p(F.col(r), F.col(n).cast("double")))


def _beta_p(r: float, n: float) -> float | None:
    import math

    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    if r == 0:
        return 1.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                c = 1 + num / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
