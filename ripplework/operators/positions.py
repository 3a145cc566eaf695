"""Token positions of sequences: which are supervised, selected, kept, shifted, padded; vocabularies and pooled vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplework.functions import vector as V
from ripplework.operators import tiles

#: Fixed value: the label of a position that is not scored.
IGNORED = -100


def supervised_positions(labels: Column, mask: Column | None = None, most: int | None = None) -> Column:
    """Positions from 1 on with a label and not masked, the first `most` of them (F10). Position p is scored by p - 1."""
    at = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    ok = lambda i: (i < F.size(labels)) & (F.get(labels, i) != IGNORED) & (F.lit(True) if mask is None else F.get(mask, i) != 0)
    out = F.filter(at, ok)
    return out if most is None else F.slice(out, 1, max(most, 0))


def low_likelihood(df: DataFrame, sequence: str, pos: str, p: str, ratio: float) -> DataFrame:
    """The ceil(n * ratio) least likely positions of each sequence, one at least, ties to the earlier."""
    if ratio >= 1:
        return df
    by = W.partitionBy(sequence)
    rank, n = F.row_number().over(by.orderBy(p, pos)), F.count("*").over(by)
    return df.withColumn("__r", rank).withColumn("__n", n).where(F.col("__r") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(ratio)))).drop("__r", "__n")


def answer_offset(texts: Column, markers: Sequence[str]) -> Column:
    """The token with the first character, white space aside, behind the last of the markers; null without one."""
    def best(decoded: Column) -> Column:
        starts = []
        for m in markers:
            back = F.instr(F.reverse(decoded), m[::-1])
            starts.append(F.when(back > 0, F.length(decoded) - back + 1))  # where the marker's last occurrence ends
        begins = F.array(*[F.struct((s - len(m)).alias("b"), F.lit(-i).alias("i"), s.alias("e")) for i, (s, m) in enumerate(zip(starts, markers, strict=True))])
        return F.array_max(F.filter(begins, lambda x: x["b"].isNotNull()))

    def begin(decoded: Column, end: Column) -> Column:
        space = lambda rest: F.length(rest) - F.length(F.regexp_replace(rest, r"(?U)^[\s\x1c-\x1f]+", ""))
        return end + _once(F.substr(decoded, end + 1), space)

    place = _once(F.array_join(texts, ""), lambda d: _once(best(d)["e"], lambda e: F.when(e.isNotNull(), begin(d, e))))
    return _once(place, lambda at: F.when(at.isNotNull(), first_beyond(texts, at)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is worked out once, however often it stands in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_beyond(texts: Column, begin: Column) -> Column:
    """The first token that ends behind a character place; null if none does. One fold that holds the place and two numbers."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("i"), begin.alias("begin"))
    step = lambda s, t: F.struct((s["end"] + F.length(t)).alias("end"), (s["i"] + (s["end"] + F.length(t) <= s["begin"]).cast("int")).alias("i"), s["begin"].alias("begin"))
    return _once(F.aggregate(texts, start, step)["i"], lambda at: F.when(at < F.size(texts), at))


def update_positions(positions: Column, texts: Column, mode: str, markers: Sequence[str] = ("####",)) -> Column:
    """Of supervised positions and their texts: all, the first, or the first of the final answer."""
    if mode == "all_supervised":
        return positions
    if mode == "first_response_token":
        return F.slice(positions, 1, 1)
    if mode != "first_final_answer_token":
        raise ValueError(f"unknown mode: {mode}")
    return _once(answer_offset(texts, markers), lambda at: F.when(at.isNotNull(), F.slice(positions, at + 1, 1)).otherwise(F.array().cast("array<int>")))


def target_positions(ends: Column, prompt_length: Column) -> Column:
    """Positions behind the first whose token ends behind the prompt."""
    return F.filter(F.transform(ends, lambda e, i: F.when((e > prompt_length) & (i > 0), i)), lambda i: i.isNotNull())


def answer_position(ends: Column, prompt_length: Column, trimmed: Column) -> Column:
    """The first target position once `trimmed` tokens are cut off the left; null if it went with them."""
    at = F.get(target_positions(ends, prompt_length), F.lit(0)) - trimmed
    return F.when(at >= 0, at)


def causal(df: DataFrame, sequence: str, pos: str, value: str, out: str) -> DataFrame:
    """Adds the value at the position before, which scores this one; the first position has none and goes."""
    before = F.lag(value).over(W.partitionBy(sequence).orderBy(pos))
    first = F.lag(pos).over(W.partitionBy(sequence).orderBy(pos))
    return df.withColumn(out, before).withColumn("__p", first).where(F.col("__p") == F.col(pos) - 1).drop("__p")


def misaligned(label_pos: Column, logit_pos: Column) -> Column:
    """Whether a label is scored from elsewhere than the position before."""
    return ~logit_pos.eqNullSafe(label_pos - 1)


def trimmed_left(a: Column, n: int) -> Column:
    """The last n entries, so that the completion stays."""
    return F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n)


def batch_vocabulary(df: DataFrame, logits: str, k: int) -> DataFrame:
    """(id): all ids among the k largest logits of a row, ties to the smaller id."""
    pairs = F.transform(F.col(logits), lambda x, i: F.struct((-x.cast("double")).alias("x"), i.alias("i")))
    return df.select(F.explode(F.transform(F.slice(F.array_sort(pairs), 1, k), lambda r: r["i"])).alias("id")).distinct()


def vocabulary(*frames: DataFrame, tokens: str = "tok") -> DataFrame:
    """(tokens): the distinct tokens of several frames' arrays (U04); order them where they are shown."""
    out = frames[0].select(F.explode(F.array_distinct(tokens)).alias(tokens))
    for f in frames[1:]:
        out = out.union(f.select(F.explode(F.array_distinct(tokens)).alias(tokens)))
    return out.distinct()


def observation_baselines(updates: DataFrame, observations: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, dot/cosine/centred mean, sum, max) of each observation over all update tokens, by tiles (V06); keys are whole numbers."""
    side = lambda df: tiles.records(df, key, F.concat(V.doubles(F.col(vector)), V.centred(F.col(vector))), 2 * width)
    parts = tiles.baselines(side(updates), side(observations), width).groupBy(F.col("id").alias(key))
    sums = parts.agg(*[f(f"{c}_{n}").alias(f"{c}_{n}") for c in ("dot", "cosine", "centred") for f, n in ((F.sum, "n"), (F.sum, "s"), (F.max, "m"))])
    total = lambda c: F.when(F.col(c + "_n") > 0, F.col(c + "_s"))
    return sums.select(key, *[x.alias(f"{c}_{n}") for c in ("dot", "cosine", "centred") for x, n in ((total(c) / F.col(c + "_n"), "mean"), (total(c), "sum"), (F.col(c + "_m"), "max"))])


def pooled(df: DataFrame, sequence: str, pos: str, mask: str, vector: str, how: str) -> DataFrame:
    """(sequence, pooled): the masked mean or the last unmasked token's vector, then of length 1.

    A sequence without an unmasked token has the zero vector as its mean, and its first token as its last.
    """
    v = V.doubles(F.col(vector))
    if how == "mean":
        on = (F.col(mask) != 0).cast("double")
        dims = df.select(sequence, on.alias("__m"), F.posexplode(v).alias("__d", "__x")).groupBy(sequence, "__d").agg((F.sum(F.col("__x") * F.col("__m")) / F.greatest(F.sum("__m"), F.lit(1.0))).alias("__x"))
        out = dims.groupBy(sequence).agg(F.transform(F.array_sort(F.collect_list(F.struct("__d", "__x"))), lambda r: r["__x"]).alias("pooled"))
    elif how == "last_token":
        out = df.groupBy(sequence).agg(F.coalesce(F.max_by(v, F.when(F.col(mask) != 0, F.col(pos))), F.min_by(v, F.col(pos))).alias("pooled"))
    else:
        raise ValueError(f"unknown pooling: {how}")
    n = F.greatest(V.norm(F.col("pooled")), F.lit(1e-12))
    return out.withColumn("pooled", F.zip_with("pooled", F.array_repeat(n, F.size("pooled")), lambda x, s: x / s))
