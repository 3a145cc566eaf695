"""Mixing sources to target weights as a time-varying curriculum. Native: DataFrame functions only.

Each source has a weight schedule over training time. Its integral is the source's cumulative token demand; inverting
that integral at a document's cumulative token offset gives the document's training position, and a range sort by
position gives the training order.

Sums over a source are two-level: documents fall into hash-ordered buckets of about `bucket_rows` rows, a running sum
over bucket totals gives each bucket's start, and a running sum inside the bucket finishes it. A source with a third
of all rows thus spreads over as many tasks as it has buckets.

Defined results: null text has size 0; a null source is a source of its own, last; a source without words takes none;
equal ids are ordered by size; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplework.llm.common import sql_words, word_count
from ripplework.session import materialize, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2.0
BUCKET_ROWS = 4096
#: Weight of a source over training time, as (time, factor) points joined by lines; sources take the curves in turn.
CURVES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size, rank, target) from (source, size): weights by rank of the source's code points, null last.

    Targets share `share` of all sizes by weight and stop at `repeats` times the source's size; the excess goes to the
    others by weight until none is above. With sources sorted by cap / weight, that level is the first one at which
    what is left, divided by the weights left, stays under the next cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(repeats)
    by_cap = W.orderBy(F.col("source_size") * F.lit(repeats) / F.col("weight"), "rank")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy(F.lit(1))
    level = (F.lit(share) * F.sum("source_size").over(everyone) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    fits = F.col("level") <= cap / F.col("weight")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, cap / F.col("weight"))).over(everyone)
    return per.select("source", "source_size", "rank", F.when(level.isNull(), cap).otherwise(F.least(cap, F.col("weight") * level)).alias("target"))


def _running(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """Adds `before`: the sizes of the source's documents ahead of this one in hash order; source, bucket and nth name a row."""
    n = docs.groupBy("source").agg(F.count("*").alias("rows"))
    cells = F.floor(F.col("rows") / F.lit(bucket_rows)) + 1
    docs = docs.join(n, docs["source"].eqNullSafe(n["source"])).select(docs["*"], F.floor(F.col("key") * cells / F.lit(1 << 32)).alias("bucket"))
    totals = docs.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    starts = totals.select("source", "bucket", (F.sum("total").over(W.partitionBy("source").orderBy("bucket")) - F.col("total")).alias("begin"))
    inside = W.partitionBy("source", "bucket").orderBy("key", "tie", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    local = docs.withColumn("local", F.sum("size").over(inside) - F.col("size")).withColumn("nth", F.row_number().over(inside))
    hit = local["source"].eqNullSafe(starts["source"]) & (local["bucket"] == starts["bucket"])
    return local.join(starts, hit).select(local["*"], (F.col("local") + F.col("begin")).alias("before"))


def positions(offset: Column, target: Column, rank: Column, curves=CURVES) -> Column:
    """Training time in [0, 1] at which a source's cumulative demand reaches `offset` of `target`: the integral's inverse."""
    out = None
    for k, curve in enumerate(curves):
        total = sum((a + b) / 2 * (t1 - t0) for (t0, a), (t1, b) in zip(curve, curve[1:], strict=False))
        need = F.when(target > 0, offset / target).otherwise(F.lit(0.0)) * F.lit(total)
        at, start = F.lit(1.0), total
        for (t0, a), (t1, b) in reversed(list(zip(curve, curve[1:], strict=False))):
            end, start = start, start - (a + b) / 2 * (t1 - t0)
            left = F.greatest(need - F.lit(start), F.lit(0.0))
            slope = (b - a) / (t1 - t0)
            spent = left / F.lit(a) if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * left, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
            at = F.when(need < F.lit(end), F.least(F.lit(t1), F.lit(t0) + spent)).otherwise(at)
        out = at if out is None else F.when(rank % len(curves) == k, at).otherwise(out)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, rank, before, taken.

    Every pass over a source takes its documents in hash order; the last pass stops where the target is reached, so a
    document may be taken in part (its first words).
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("null")))
    narrow = narrow.withColumn("key", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")).withColumn("tie", F.substring(digest, 9, 24))
    narrow = materialize(narrow, "mix")
    targets = source_targets(narrow, weights, share, repeats)
    rows = _running(narrow, bucket_rows)
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(rows["*"], targets["source_size"], targets["rank"], targets["target"])
    goal = F.round(F.col("target")).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rest = goal - passes * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.withColumn("taken", (passes * F.col("size") + last).cast("long"))


def copies(m: DataFrame, curves=CURVES) -> DataFrame:
    """The rows of mix() with copy, position and words, one for each time a document is taken; untaken ones once, words 0.

    Copy c of a document starts when its source has given c passes and what is ahead of the document in this pass.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int"))
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))
    offset = F.col("copy") * F.col("source_size") + F.col("before")
    m = m.withColumn("position", positions(offset.cast("double"), F.col("target"), F.col("rank"), curves))
    return m.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")))


def _in_order(rows: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.repartitionByRange("position", id_col, "copy").sortWithinPartitions("position", id_col, "copy")


def schedule(docs: DataFrame, curves=CURVES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The training order: (id, copy, position, words), one row for each time a document is taken, range-sorted by position."""
    m = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    return _in_order(copies(m, curves).where("taken > 0").select("id", "copy", "position", "words"))


def mixed_documents(docs: DataFrame, curves=CURVES, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix as documents: each as often as it is taken, with all its columns; a last copy counts if half of it is taken.

    Training order: every copy has its own position, the rows are range-partitioned and sorted by it, so files read in
    name order follow the curriculum. A document without words is kept once: the mix is of words and has no say on it.
    """
    m = copies(mix(docs, id_col=id_col, **options), curves).where("2 * words >= size and (taken > 0 or size = 0)")
    m = m.groupBy("id", "copy").agg(F.min("position").alias("position")).withColumnsRenamed({"id": "__id", "copy": "__copy", "position": "__position"})
    out = docs.join(m, docs[id_col].eqNullSafe(m["__id"]))
    order = ("__position", id_col, "__copy")
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*[docs[c] for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """What each document gives, summed over its copies in the training order, which is written out with all positions."""
    key = ("source", "bucket", "nth")
    m = copies(mix(table(spark, sf_dir, "documents")))
    order = materialize(_in_order(m.select(*key, "id", "copy", "position", "words", "size", "source_size", "target")), "schedule")
    rows = order.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("id", "size", "source_size", "target")], F.sum("words").alias("taken"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_training_order(spark, sf_dir: str) -> DataFrame:
    """The training order itself: every copy with its position. It has no twin, a test holds it against brute force."""
    return schedule(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, len({sql_words("text")})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(level, cap / weight) FILTER (level <= cap / weight) AS level FROM l),
t AS (SELECT w.source, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, weight * f.level) END AS target FROM w, f),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS goal,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS bef
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * size
   + greatest(0, least(size, goal - (CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END) * source_size - bef)))::BIGINT AS taken
FROM c
"""
