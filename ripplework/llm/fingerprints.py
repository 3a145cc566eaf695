"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k least 40-bit hashes of a text's shingles and whether those are all. Sketches of parts merge to the
sketch of the whole (of their shingles); two sketches estimate resemblance and containment, one the number of distinct
shingles. Texts with at most k shingles are compared exactly.

Defined results: null text is empty; two empty texts have likeness 1, an empty and another 0; a text of fewer than five
words is one shingle, so its likeness to any text of other words is 0; equal ids are ordered by
their text's hash; the next of the last document is the first; a single document is its own next; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import WordHashes, release, shingles, slices
from ripplework.session import table

K = 256
SPACE_BITS = 40
PARTS = 4
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles bigint"


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least of the distinct 40-bit hashes."""
    h = np.unique(hashes >> np.uint64(64 - SPACE_BITS))
    return h[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def count(a: np.ndarray, k: int = K) -> int:
    """Distinct shingles: exact under k, else estimated from the k-th least hash."""
    return len(a) if len(a) < k else round((k - 1) * 2.0**SPACE_BITS / float(a[k - 1]))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of the union's k least hashes that both have: Jaccard similarity."""
    if not len(a) and not len(b):
        return 1.0
    u = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= u[-1])) / len(u)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b has."""
    n = count(a, k)
    if not n:
        return 1.0
    return min(1.0, resemblance(a, b, k) * count(merge(a, b, k), k) / n)


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)[:, : SPACE_BITS // 8].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, SPACE_BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : SPACE_BITS // 8] = raw
    return wide.view("<u8").ravel().astype(np.uint64)


def edited(text: str, after: str) -> str:
    """The last third of a text replaced by as much of the next one's beginning."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def with_next(rows: DataFrame, parts: int) -> DataFrame:
    """Adds part, ctx: rows dealt into ranges of descending doc_id, each followed by a copy of the first row after it.

    The bounds are ids that occur, so the row after a range is the first of the next one and its copies are found by
    equality; there are as many copies as ranges. The last range is followed by the first row of all.
    """
    q = [i / parts for i in range(1, parts)]
    got = rows.agg(F.max("doc_id").alias("top"), F.min("doc_id").alias("low"), F.percentile_approx("doc_id", F.array(*map(F.lit, q or [0.5])), 10_000).alias("q")).first()
    if got["top"] is None:
        bounds = []
    else:
        bounds = sorted({x for x in (got["q"] if q else []) if x != got["top"]}, reverse=True)
    at = F.lit(0)
    if bounds:
        at = F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda b: b >= F.col("doc_id")))
    at = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(at)
    rows = rows.withColumn("part", at)
    firsts = [b for b in bounds] if bounds else []
    copies = F.when(F.col("doc_id").isin(firsts), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("ctx")), F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("ctx")))) if firsts else F.when(F.lit(False), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("ctx"))))
    own = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("ctx")))
    copies = F.coalesce(copies, own)
    end = F.array(F.struct(F.lit(len(bounds)).alias("part"), F.lit(1).alias("ctx")))
    is_top = F.col("doc_id") == F.lit(got["top"]).cast("bigint") if got["top"] is not None else F.col("doc_id").isNull()
    copies = F.when(F.coalesce(is_top, F.lit(False)), F.concat(copies, end)).otherwise(copies)
    return rows.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.part", "c.ctx")


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and its edited text, and likenesses to the edited and the next text (see SCHEMA).

    One shuffle of the texts, by ranges of the id; a task holds two rows at a time.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_next(rows, parts).repartitionByRange(parts, "part").sortWithinPartitions("part", "ctx", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))

    def run(batches):
        hashes = WordHashes()
        before, out = None, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        for some in slices(batches):
            for i, text, part, ctx in some:
                text = text or ""
                if before is not None and before[3] == part and not before[4]:
                    i0, text0, s0, *_ = before
                    new = edited(text0, text)
                    s1 = sketch(shingles(new, hashes), k)
                    s = sketch(shingles(text, hashes), k)
                    out.append((i0, len(text0), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), to_text(s0), to_text(s1), resemblance(s0, s1, k), resemblance(s0, s, k), count(s0, k)))
                else:
                    s = sketch(shingles(text, hashes), k)
                before = (i, text, s, part, ctx)
                if len(out) >= 500:
                    yield batch()
                    out = []
        if out:
            yield batch()
        release()

    return dealt.mapInArrow(run, SCHEMA)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents"))
