"""Checks of rankings, logs and splits, subset selection, and rows that fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ripplework.functions import text as T
from ripplework.operators.core import prefix_sum, require


def ranking_faults(ranked: DataFrame, query: str, rank: str, candidate: str, known: DataFrame, meta: list[str]) -> DataFrame:
    """(query, n, ranks_ok, unique, meta_ok) of each ranking: ranks are 1 to n, no candidate stands twice, every candidate is
    known and carries the metadata it has there (G06). A ranking is one query's top rows."""
    k = known.select(F.col(candidate).alias("__c"), F.struct(*meta).alias("__m"))
    j = ranked.join(k, F.col(candidate) == F.col("__c"), "left").withColumn("__ok", F.coalesce(F.struct(*[ranked[m] for m in meta]).eqNullSafe(F.col("__m")) & F.col("__c").isNotNull(), F.lit(False)))
    n = F.count("*")
    ok = (F.min(rank) == 1) & (F.max(rank) == n) & (F.count_distinct(rank) == n)
    return j.groupBy(query).agg(n.alias("n"), F.coalesce(ok, F.lit(False)).alias("ranks_ok"), (F.count_distinct(candidate) == n).alias("unique"), F.bool_and("__ok").alias("meta_ok"))


def log_summary(log: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """(run, losses, finite, first, middle, last, decreased) of training logs; rows without a loss are other entries.

    The middle loss is the one at place floor(n / 2) from 0. A log that is not finite anywhere is told, not dropped.
    """
    rows = log.where(F.col(loss).isNotNull()).select(run, step, F.col(loss).cast("double").alias("__y"), F.lit(1).cast("bigint").alias("__one"))
    rows = prefix_sum(rows, step, "__one", (run,), out="__i").drop("__one")
    n = rows.groupBy(run).agg(F.count("*").alias("losses"), F.bool_and(~F.isnan("__y") & (F.abs("__y") != float("inf"))).alias("finite")).withColumnRenamed(run, "__r")
    rows = rows.join(n, rows[run].eqNullSafe(n["__r"]))
    at = lambda i: F.max(F.when(F.col("__i") == i, F.col("__y")))
    out = rows.groupBy(run, "losses", "finite").agg(at(F.lit(0)).alias("first"), at(F.floor(F.col("losses") / 2)).alias("middle"), at(F.col("losses") - 1).alias("last"))
    return out.withColumn("decreased", F.col("last") < F.col("first"))


def first_valid(df: DataFrame, by: str, order: str, valid: Column, k: int, out: str = "part") -> DataFrame:
    """Valid rows with `out`: the first k of each group by order are held out, the others train."""
    rows = df.where(F.coalesce(valid, F.lit(False))).withColumn("__one", F.lit(1).cast("bigint"))
    return prefix_sum(rows, order, "__one", (by,), out="__i").withColumn(out, F.when(F.col("__i") < k, "held").otherwise("train")).drop("__one", "__i")


def subsets(df: DataFrame, task: str, key: str, train: int, probe: int, seed: int, smaller: bool = False) -> DataFrame:
    """Rows with `subset`, train or probe, in a seeded order of each task; the two never share a row.

    A task with fewer than train + probe rows raises, unless `smaller`: then it keeps its probes if it has more rows than
    that, a fifth of its rows otherwise, and trains on the rest. The order is by md5 of seed, task and key, key.
    """
    n = df.groupBy(task).agg(F.count("*").alias("__n"))
    if not smaller:
        n = require(n, F.col("__n") < train + probe, f"fewer than {train + probe} rows in a task")
    few = F.col("__n") < train + probe
    probes = F.when(few & (F.col("__n") <= probe), F.floor(F.col("__n") / 5)).otherwise(probe)
    n = n.select(F.col(task).alias("__t"), F.when(few, F.col("__n") - probes).otherwise(train).alias("__train"), probes.alias("__probe"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(task).cast("string"), F.col(key).cast("string")))
    place = F.row_number().over(W.partitionBy(task).orderBy(h, key))
    rows = df.withColumn("__i", place).where(F.col("__i") <= train + probe)  # the first of each task only are ranked
    rows = rows.join(n, rows[task].eqNullSafe(n["__t"])).where(F.col("__i") <= F.col("__train") + F.col("__probe"))
    return rows.select(*df.columns, F.when(F.col("__i") <= F.col("__train"), "train").otherwise("probe").alias("subset"))


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """`a`, raising at run time on a row whose key is in `b` too (U06); null keys meet nothing."""
    known = b.select(F.col(key).alias("__k")).where("__k is not null").distinct()
    j = a.join(known, F.col(key) == F.col("__k"), "left")
    return require(j, F.col("__k").isNotNull(), f"a {key} stands on both sides").drop("__k")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key) on both sides."""
    return a.select(key).where(F.col(key).isNotNull()).intersect(b.select(key))


def attempted(df: DataFrame, attempt: Column, out: str, why: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `out`, rows that failed with `__why`): a row whose attempt gives null is dropped and told, and the run goes on.

    `attempt` is built from the try_ functions, which give null where the plain ones raise.
    """
    tried = df.withColumn(out, attempt)
    return tried.where(F.col(out).isNotNull()), tried.where(F.col(out).isNull()).drop(out).withColumn("__why", F.lit(why))


#: The language each task is converted to, and what its records are then called.
CONVERSIONS = {"mbpp": ("English", "unchanged"), "gsm8k": ("Chinese", "translated"), "dolly_qa": ("French", "translated")}
_ANNOTATION = r"<<[^>]+>>"


def converted(records: DataFrame, done: DataFrame | None = None, translator=None) -> DataFrame:
    """(example_id, task, target_language, translation_status, messages) of records (example_id, task, messages).

    The task tells the language; an unknown task raises. Records whose id is in `done` are passed over, so a run that broke
    off goes on where it stopped. `translator` takes batches (texts, languages); without one texts stay as they are. Each
    message is translated on its own and messages come back in their order; unchanged tasks do not reach the translator.
    """
    rows = records.select("example_id", "task", "messages")
    if done is not None:
        rows = rows.join(done.select("example_id").distinct(), "example_id", "left_anti")
    known = reduce(lambda c, t: c.when(F.col("task") == t, F.struct(*[F.lit(v).alias(n) for v, n in zip(CONVERSIONS[t], ("language", "status"), strict=True)])), CONVERSIONS, F)
    rows = require(rows.withColumn("__to", known), F.col("__to").isNull(), "unsupported task")
    rows = rows.withColumns({"target_language": F.col("__to.language"), "translation_status": F.col("__to.status")}).drop("__to")
    if translator is not None:
        own = F.col("translation_status") == "translated"
        each = rows.where(own).select("example_id", "task", "target_language", "translation_status", F.posexplode_outer("messages").alias("__i", "__m"))
        each = each.withColumn("__t", F.pandas_udf(translator, StringType())(F.col("__m.content"), F.col("target_language")))
        message = F.struct(F.col("__m.role").alias("role"), F.col("__t").alias("content"))
        some = F.sort_array(F.collect_list(F.when(F.col("__i").isNotNull(), F.struct("__i", message.alias("m")))))  # the messages of one record
        back = each.groupBy("example_id", "task", "target_language", "translation_status").agg(some.alias("__s"))
        back = back.select("example_id", "task", "target_language", "translation_status", F.col("__s.m").cast(records.schema["messages"].dataType).alias("messages"))
        rows = rows.where(~own).select(*back.columns).union(back)
    return rows.select("example_id", "task", "target_language", "translation_status", "messages")


def record_errors(source: DataFrame, output: DataFrame) -> DataFrame:
    """(example_id, errors) of every record on either side, an array that is empty if all is well.

    Records are (example_id, task, messages). Missing ids and another number of messages end the list; otherwise every
    message must keep its role and not be blank, tasks called unchanged must be equal, and gsm8k must keep its numbers,
    `<<...>>` annotations and final answer.
    """
    s = source.select("example_id", F.col("task").alias("__task"), F.col("messages").alias("__was"))
    j = s.join(output.select("example_id", F.col("messages").alias("__is"), F.lit(True).alias("__out")), "example_id", "full")
    unchanged = F.col("__task").isin([t for t, (_, status) in CONVERSIONS.items() if status == "unchanged"])
    text = lambda m: F.coalesce(m["content"], F.lit(""))
    notes = lambda m: F.regexp_extract_all(text(m), F.lit(_ANNOTATION), F.lit(0))
    differs = lambda f: F.exists(F.arrays_zip("__was", "__is"), lambda z: ~f(z["__was"]).eqNullSafe(f(z["__is"])))
    maths = F.col("__task") == "gsm8k"
    said = {
        "empty message": F.exists("__is", lambda m: F.trim(text(m)) == ""),
        "role changed": differs(lambda m: m["role"]),
        "messages changed": unchanged & ~F.col("__was").eqNullSafe(F.col("__is")),
        "numbers changed": maths & differs(lambda m: T.numbers(text(m))),
        "annotations changed": maths & differs(notes),
        "answer changed": maths & differs(lambda m: T.gold_number(text(m))),
    }
    inside = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in said.items()]))
    none = F.array(F.lit("missing source")), F.array(F.lit("missing output")), F.array(F.lit("message count changed"))
    errors = F.when(F.col("__task").isNull(), none[0]).when(F.col("__out").isNull(), none[1]).when(~F.size("__was").eqNullSafe(F.size("__is")), none[2]).otherwise(inside)
    return j.select("example_id", errors.alias("errors"))
