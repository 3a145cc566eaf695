"""Quality rules: a learned decision list. Native: DataFrame functions only.

Statistics of each text are cut into bins at quantiles of labelled rows. Sequential covering grows a conjunction of
thresholds by information gain over labelled counts, prunes it on rows held out, keeps it if it is precise there,
takes out what it covers and starts again. The list is emitted as ordered Spark conditional expressions.

Each step is one aggregate over the labelled rows; the driver sees counts by (statistic, bin, label) only. At most
`fit_rows` labelled rows, by hash order, are used: that bound is the only one; every text is judged whole.

Defined results: null or empty text has all counts 0 and fails the base test; repeated ids are judged row by row; rows
with null labels are not fitted on; without labels the list is empty and everything that passes the base test is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import NON_SPACE, words
from ripplework.session import materialize, table

FIT_ROWS = 20_000
BINS = 12
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.95
MIN_COVER = 5
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "bangs", "distinct_words", "line_words")


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and helper columns (__text, __words, __lines)."""
    df = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__words", words(F.col("__text")))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(NON_SPACE)))
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.regexp_replace("__text", r"[\x20\x09-\x0D]+", "")).cast("long"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    df = df.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.slice("__h", 1, F.greatest(F.lit(0), F.size("__h") - 4)), lambda x, i: F.xxhash64(x, *[F.get("__h", i + k) for k in range(1, 5)]))
    df = df.withColumn("__windows", windows)
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    pair = lambda x, i: F.struct(x.alias("h"), i.alias("i"))
    df = df.withColumn("__sorted", F.when(again, F.sort_array(F.transform("__windows", pair))))
    near = lambda x, j, k: F.get("__sorted", j + k)["h"].eqNullSafe(x["h"])
    starts = F.sort_array(F.transform(F.filter("__sorted", lambda x, j: ((j > 0) & near(x, j, -1)) | near(x, j, 1)), lambda x: x["i"]))
    df = df.withColumn("__starts", starts)
    covered = F.transform("__starts", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("__starts", k + 1) - p, F.lit(5))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("__h", "__windows", "__sorted", "__starts")


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base counts and the ratios that rules are learned from."""
    df = base_counts(df, text_col)
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    count = lambda p: F.length(F.regexp_replace("__text", p, ""))
    return (
        df.withColumn("word_length", F.col("word_chars") / n)
        .withColumn("symbols", F.col("n_symbols") / n)
        .withColumn("dup_lines", F.col("n_dup_lines") / F.greatest(F.size("__lines"), F.lit(1)).cast("double"))
        .withColumn("repeat_words", F.col("n_repeat_words") / n)
        .withColumn("upper", count(r"[^A-Z]+") / chars)
        .withColumn("digits", count(r"[^0-9]+") / chars)
        .withColumn("bangs", count(r"[^!?]+") / n)
        .withColumn("distinct_words", F.size(F.array_distinct("__words")) / n)
        .withColumn("line_words", n / F.greatest(F.size("__lines"), F.lit(1)))
        .drop("__text", "__words", "__lines")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _covered(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _all(r)
    return out


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def fit(labelled: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER, bins: int = BINS) -> list[Rule]:
    """Rules that reject, in order, from rows with STATISTICS, `bad` (boolean) and `fold` (0: held out for pruning)."""
    levels = [i / bins for i in range(1, bins)]
    cuts = labelled.agg(*[F.percentile_approx(s, F.array(*map(F.lit, levels)), 2000).alias(s) for s in STATISTICS]).first()
    cuts = {s: sorted(set(cuts[s] or [])) for s in STATISTICS}
    cells = F.array(*[F.struct(F.lit(s).alias("s"), sum((F.when(F.col(s) > t, 1).otherwise(0) for t in ts), F.lit(0)).alias("b")) for s, ts in cuts.items() if ts])
    if not any(cuts.values()):
        return []
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = labelled.where(~_covered(rules))
        rule: Rule = ()
        while len(rule) < max_conditions:
            rows = left.where((F.col("fold") != 0) & _all(rule))
            counts = {(r["s"], r["b"], r["bad"]): r["n"] for r in rows.select("bad", F.explode(cells).alias("c")).groupBy("c.s", "c.b", "bad").agg(F.count("*").alias("n")).collect()}
            first = next(s for s in STATISTICS if cuts[s])
            p0, n0 = (sum(v for (s, _, bad), v in counts.items() if s == first and bad is want) for want in (True, False))
            best = (0.0, None)
            for s in STATISTICS:
                for i, t in enumerate(cuts[s]):
                    for above in (True, False):
                        p, n = (sum(v for (k, b, bad), v in counts.items() if k == s and bad is want and (b > i) == above) for want in (True, False))
                        if p >= min_cover and (g := _gain(p, n, p0, n0)) > best[0] + 1e-9:
                            best = (g, Condition(s, above, float(t)))
            if not n0 or best[1] is None:
                break
            rule = (*rule, best[1])
        if not rule:
            break
        held = left.where(F.col("fold") == 0)
        seen = held.agg(*[F.count_if(_all(rule[:k]) & (F.col("bad") == bad)).alias(f"{'p' if bad else 'n'}{k}") for k in range(1, len(rule) + 1) for bad in (True, False)]).first()
        worth = lambda k: ((seen[f"p{k}"] - seen[f"n{k}"]) / max(1, seen[f"p{k}"] + seen[f"n{k}"]), -k)
        k = max(range(1, len(rule) + 1), key=worth)
        if seen[f"p{k}"] < min_cover or seen[f"p{k}"] < min_precision * (seen[f"p{k}"] + seen[f"n{k}"]):
            break
        rules.append(rule[:k])
    return rules


def decision(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the first rule that fits rejects and is named, else null (keep)."""
    out = None
    for i, r in enumerate(rules):
        said = F.lit(f"{i + 1}: " + " and ".join(map(str, r)))
        out = F.when(_all(r), said) if out is None else out.when(_all(r), said)
    return F.lit(None).cast("string") if out is None else out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Statistics of at most `fit_rows` labelled documents, the first by hash of their id."""
    h = F.xxhash64(F.col("__id"))
    few = labels.select(F.col(id_col).alias("__id"), (F.col(label_col) == 0).alias("bad")).where("__id is not null and bad is not null").orderBy(h, "__id").limit(fit_rows)
    few = few.groupBy("__id").agg(F.min("bad").alias("bad"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(few), "__id")  # at most fit_rows rows
    rows = statistics(rows, "__t").select("bad", F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(3)).alias("fold"), base_failed().alias("base"), *STATISTICS)
    return materialize(rows, "labelled").where("not base")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, counts, base_failed, rule, kept) of every row."""
    rules = fit(labelled_sample(docs, labels, id_col, text_col=text_col), **options)
    rows = statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = rows.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return rows.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    rules = fit(labelled_sample(docs, labels, id_col, text_col=text_col), **options)
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    rows = statistics(docs.select(*[F.col(c).alias(a) for c, a in own.items()]), own[text_col])
    # A filter on a deterministic column moves below the projections and takes copies of the nested expressions along.
    rows = rows.withColumn("__ok", ~base_failed() & decision(rules).isNull() & (F.monotonically_increasing_id() >= 0))
    return rows.where("__ok").select(*[F.col(a).alias(c) for c, a in own.items()])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    j = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return j.withColumnRenamed("id", "doc_id")
