"""Rows into records: messages, candidates, look-ups, zips, reshapes, and the filters that go with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplework.functions import text as T
from ripplework.operators.core import hash_order, prefix_sum, require

#: Column names that hold a prompt or a response, in order of preference.
PROMPTS = ("prompt", "instruction", "question", "input", "text")
RESPONSES = ("response", "completion", "answer", "output", "code")
#: Who speaks under which name.
USERS, ASSISTANTS = ("human", "user"), ("gpt", "assistant", "bot")
MESSAGES = "array<struct<role:string,content:string>>"


def _said(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def pair_messages(df: DataFrame) -> Column:
    """Two messages from the first prompt and response column a frame has; raises if it has none."""
    found = [next((F.col(c) for c in names if c in df.columns), None) for names in (PROMPTS, RESPONSES)]
    if any(c is None for c in found):
        raise ValueError(f"no prompt and response among {sorted(df.columns)}")
    return F.array(_said("user", found[0]), _said("assistant", found[1]))


def instruction_messages(instruction: Column, context: Column, response: Column) -> Column:
    """An instruction with its context, if that is not blank, and the response."""
    c = T.strip(F.coalesce(context, F.lit("")))
    prompt = F.concat(F.lit("Instruction: "), instruction, F.when(c != "", F.concat(F.lit("\n\nContext: "), c)).otherwise(""))
    return F.array(_said("user", prompt), _said("assistant", response))


def task_messages(task: Column, tests: Column, setup: Column, code: Column) -> Column:
    """A programming task with its tests and set-up, and the code."""
    s = T.strip(F.coalesce(setup, F.lit("")))
    lines = F.array(F.lit("Write a Python function that solves the following programming task."), F.lit(""), F.concat(F.lit("Task: "), task))
    given = F.when(F.size(tests) > 0, F.concat(F.array(F.lit(""), F.lit("The solution should satisfy these tests:")), tests)).otherwise(F.array().cast("array<string>"))
    more = F.when(s != "", F.array(F.lit(""), F.lit("Test setup:"), s)).otherwise(F.array().cast("array<string>"))
    return F.array(_said("user", F.array_join(F.concat(lines, given, more), "\n")), _said("assistant", code))


def turn_messages(turns: Column, role: str | None = None, content: str | None = None) -> Column:
    """Turns, as strings or as structs with these fields, to messages; blank ones go.

    A known speaker is user or assistant, another keeps its name, and one without a name speaks by its place, users first.
    """
    place = lambda i: F.when(i % 2 == 0, "user").otherwise("assistant")

    def one(t: Column, i: Column) -> Column:
        if content is None:
            return F.struct(place(i).alias("role"), T.strip(t).alias("content"))
        name = F.lower(T.strip(F.coalesce(t[role], F.lit(""))))
        who = F.when(name.isin(*USERS), "user").when(name.isin(*ASSISTANTS), "assistant").when(name == "", place(i)).otherwise(name)
        return F.struct(who.alias("role"), T.strip(F.coalesce(t[content], F.lit(""))).alias("content"))

    return F.filter(F.transform(turns, one), lambda m: m["content"] != "")


def answered(messages: Column) -> Column:
    """Whether an assistant speaks."""
    return F.exists(messages, lambda m: m["role"] == "assistant")


def fits_context(prompt_tokens: Column, completion_tokens: Column, max_length: int, least: int = 16) -> Column:
    """A completion of at least `least` tokens, and a prompt that leaves room for them."""
    return (completion_tokens >= least) & (prompt_tokens <= max_length - least)


def not_blank(c: Column) -> Column:
    return T.strip(F.coalesce(c, F.lit(""))) != ""  # F11


def year_from(c: Column, least: int) -> Column:
    """Null passes; else the first four characters must be a year from `least` on."""
    return c.isNull() | F.coalesce(F.substring(c.cast("string"), 1, 4).try_cast("int") >= least, F.lit(False))


def renumbered(df: DataFrame, category: str, order: str, wanted: Sequence[str], out: str = "index") -> DataFrame:
    """Rows of the wanted categories, numbered from 0 in each by `order`."""
    rows = df.where(F.col(category).isin(list(wanted))).withColumn("__one", F.lit(1).cast("bigint"))
    return prefix_sum(rows, order, "__one", (category,), out=out).drop("__one")


def candidates(df: DataFrame, order: str, languages: Sequence[str], out: str = "train_index") -> DataFrame:
    """One row for each row and language, numbered in that order without a global sort."""
    rows = prefix_sum(df.withColumn("__one", F.lit(1).cast("bigint")), order, "__one", out="__row").drop("__one")
    rows = rows.select(*df.columns, "__row", F.posexplode(F.array(*map(F.lit, languages))).alias("__lang", "language"))
    return rows.withColumn(out, F.col("__row") * len(languages) + F.col("__lang")).drop("__row", "__lang")


def query_text(labels: Mapping[str, tuple[str, str]], language: Column, question: Column, answer: Column | None = None) -> Column:
    """`Question: ...` and, if given, `Answer: ...` under a language's labels; an unknown language takes the first."""
    names = F.create_map(*[F.lit(x) for lang, (q, a) in labels.items() for x in (lang, q)])
    more = F.create_map(*[F.lit(x) for lang, (q, a) in labels.items() for x in (lang, a)])
    first = next(iter(labels.values()))
    out = [F.coalesce(F.try_element_at(names, language), F.lit(first[0])), F.lit(": "), question]
    if answer is not None:
        out += [F.lit("\n"), F.coalesce(F.try_element_at(more, language), F.lit(first[1])), F.lit(": "), answer]
    return F.concat(*out)


def curve(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) of a metric curve without its null rows (P01); order them where they are shown."""
    return df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")


def tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Frames under one another, each with its name as a constant column; columns they lack are null."""
    parts = [f.withColumn(tag, F.lit(name)) for name, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def matrix_rows(df: DataFrame, matrix: str, row: str, col: str, value: str) -> DataFrame:
    """Rows (row, col, value) of an array of arrays (P10)."""
    keep = [c for c in df.columns if c != matrix]
    rows = df.select(*keep, F.posexplode(matrix).alias(row, "__cells"))
    return rows.select(*keep, row, F.posexplode("__cells").alias(col, value))


def canonical(df: DataFrame, names: Mapping[str, Sequence[tuple[str, float]]]) -> DataFrame:
    """Adds each name from the first alternative the frame has, divided by that alternative's scale.

    Rows where that one is null take the next; a name without any alternative raises.
    """
    for name, options in names.items():
        have = [F.col(c) / F.lit(scale) for c, scale in options if c in df.columns]
        if not have:
            raise ValueError(f"no column for {name} among {sorted(df.columns)}")
        df = df.withColumn(name, F.coalesce(*have))
    return df


def present(metadata: Column, keys: Sequence[str]) -> Column:
    """The entries of a map whose keys are wanted."""
    return F.map_filter(metadata, lambda k, v: k.isin(list(keys)) & v.isNotNull())


def running_coordinates(df: DataFrame, names: Mapping[str, str], segment: str, epoch: str, step: str, epochs: int, offset: str) -> DataFrame:
    """Columns renamed, with continuous_epoch = (segment - 1) * epochs + epoch and global_step = offset + step."""
    df = df.withColumn("continuous_epoch", (F.col(segment) - 1) * epochs + F.col(epoch)).withColumn("global_step", F.col(offset) + F.col(step))
    return df.withColumnsRenamed(dict(names))


def with_metadata(pairs: DataFrame, metadata: DataFrame, index: str, left: str, right: str) -> DataFrame:
    """Both sides' metadata on a pair, by dense index; an index without any raises."""
    out = pairs
    for side, key in (("left_", left), ("right_", right)):
        m = metadata.select(F.col(index).alias("__i"), F.lit(True).alias("__has"), *[F.col(c).alias(side + c) for c in metadata.columns if c != index])
        out = out.join(m, out[key] == m["__i"], "left")
        out = require(out, F.col("__has").isNull(), f"{key} without metadata").drop("__i", "__has")
    return out


def zipped(df: DataFrame, *arrays: str) -> DataFrame:
    """(others, pos, arrays' items): arrays side by side; unequal lengths raise."""
    keep = [c for c in df.columns if c not in arrays]
    df = require(df, reduce(lambda a, b: a | b, [F.size(a) != F.size(arrays[0]) for a in arrays]), "lengths differ")
    return df.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "__z")).select(*keep, "pos", *[F.col(f"__z.{a}").alias(a) for a in arrays])


def mapped(df: DataFrame, name: str, patterns: Sequence[tuple[str, str]], out: str = "dataset") -> DataFrame:
    """Adds what the first fitting pattern (SQL LIKE) of a name stands for; a name that fits none raises."""
    c = F.lit(None).cast("string")
    for like, value in reversed(patterns):
        c = F.when(F.col(name).like(like), value).otherwise(c)
    return require(df.withColumn(out, c), F.col(out).isNull(), "no pattern fits")


def paired_variants(a: DataFrame, b: DataFrame, key: str, equal: Sequence[str]) -> DataFrame:
    """Variants of the same examples side by side (left_, right_); keys and the `equal` columns must agree."""
    left, right = ([F.col(c) if c == key else F.col(c).alias(p + c) for c in x.columns] for x, p in ((a, "left_"), (b, "right_")))
    j = a.select(*left, F.lit(True).alias("__a")).join(b.select(*right, F.lit(True).alias("__b")), key, "full_outer")
    j = require(j, F.col("__a").isNull() | F.col("__b").isNull(), "key sets differ")
    unequal = reduce(lambda x, y: x | y, [~F.col("left_" + c).eqNullSafe(F.col("right_" + c)) for c in equal])
    return require(j, unequal, "variants differ").drop("__a", "__b")


def sized_groups(df: DataFrame, group: str, size: int) -> DataFrame:
    """(group, n); a group of another size raises."""
    return require(df.groupBy(group).agg(F.count("*").alias("n")), F.col("n") != size, f"group of other than {size}")


def counts_map(df: DataFrame, group: str, target: str) -> DataFrame:
    """(group, counts): how often each target occurs, as a map in order of targets; a group has few of them."""
    n = df.groupBy(group, target).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(target, "n")))).alias("counts"))


def latest(df: DataFrame, group: str, path: str, modified: str) -> DataFrame:
    """(group, path): the candidate modified last, ties to the greater path."""
    return df.groupBy(group).agg(F.max(F.struct(modified, path)).alias("__m")).select(group, F.col(f"__m.{path}").alias(path))


def sample_by_domain(df: DataFrame, domain: str, key: str, per_domain: int, total: int, seed) -> DataFrame:
    """`per_domain` rows of each domain in hash order, then `total` of those in hash order."""
    w = W.partitionBy(domain).orderBy(hash_order(seed, F.col(key)), key)
    some = df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= per_domain).drop("__k")
    return some.orderBy(hash_order(seed, F.col(domain), F.col(key)), key).limit(total)


def at_least(df: DataFrame, n: int, what: str) -> DataFrame:
    """The frame; raises unless it has n rows."""
    have = df.limit(n).count()
    if have < n:
        raise ValueError(f"{what}: {have} rows, {n} wanted")
    return df


def same_order(declared: DataFrame, found: DataFrame, pos: str, index: str) -> DataFrame:
    """(pos, declared, found) where two index lists differ; empty if they are equal in order and length."""
    j = declared.select(pos, F.col(index).alias("declared")).join(found.select(pos, F.col(index).alias("found")), pos, "full_outer")
    return j.where(~F.col("declared").eqNullSafe(F.col("found")))


def recomputed(reference: DataFrame, own: DataFrame, key: str, metrics: Sequence[str], tolerance: float) -> DataFrame:
    """(key, metric, reference, own, ok) of metrics told and recomputed; a missing side is not ok."""
    sides = [x.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], list(metrics), "metric", name) for x, name in ((reference, "reference"), (own, "own"))]
    near = F.abs(F.col("reference") - F.col("own")) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs("reference"), F.abs("own")), F.lit(tolerance))
    return sides[0].join(sides[1], [key, "metric"], "full_outer").withColumn("ok", F.coalesce(near, F.lit(False)))


def translate(df: DataFrame, text: str, language: str, translator=None, out: str = "translated") -> DataFrame:
    """Adds the text in another language by a callable on Arrow batches (texts, languages) -> texts; by default the text."""
    if translator is None:
        return df.withColumn(out, F.col(text))
    return df.withColumn(out, F.pandas_udf(translator, "string")(text, language))


def domain_accumulator(df: DataFrame, key: str, domain: str, value: str, place: Sequence[str] = (), most: int = 1_000_000) -> DataFrame:
    """(key, mean, n, by_domain): an update's summary and its means by domain.

    By partial sums, or with a `place` (file, row number) in its order, whatever the tasks: a group of over `most` rows by
    ranges of `most` rows of the file, whose sums are added in order. The summary adds up domains as they first come.
    """
    if place:
        group = [F.col(key).alias("__k"), F.col(domain).alias("__d")]
        large = [r.asDict() for r in df.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > most).select("__k", "__d").collect()]  # at most rows / most
        x = df.select(*group, F.col(value).cast("double").alias("v"), *place, F.lit(None).cast("string").alias("__f"), F.lit(None).cast("bigint").alias("__r"))
        if large:
            hit = reduce(Column.__or__, (reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(r[c])) for c in r)) for r in large))
            x = x.withColumn("__f", F.when(hit, F.col(place[0]))).withColumn("__r", F.when(hit, F.floor(F.col(place[1]) / most)))
        by = ["__k", "__d", "__f", "__r"]
        x = x.repartition(*by).sortWithinPartitions(*by, *place).groupBy(*by).agg(F.sum("v").alias("s"), F.count("v").alias("n"), F.min(F.struct(*place)).alias("first"))
        added = lambda: F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("first", F.coalesce("s", F.lit(0.0)).alias("s")))), lambda r: r["s"]), F.lit(0.0), lambda a, b: a + b)
        part = x.groupBy(F.col("__k").alias(key), F.col("__d").alias(domain)).agg(added().alias("s"), F.sum("n").alias("n"), F.min("first").alias("first"))
        total = added()
    else:
        part = df.groupBy(key, domain).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
        total = F.sum("s")
    by = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(domain), F.try_divide(F.col("s"), F.col("n")).alias("m")))))
    return part.groupBy(key).agg(F.try_divide(total, F.sum("n")).alias("mean"), F.sum("n").alias("n"), by.alias("by_domain"))


def model_outputs(df: DataFrame, model, schema: str) -> DataFrame:
    """What a model makes of batches of rows: the boundary for forward passes, generation and gradients.

    `model` takes and gives pandas frames and is sent to the executors; load weights inside it, once for each worker.
    """

    def run(frames):
        for f in frames:
            yield model(f)

    return df.mapInPandas(run, schema)
