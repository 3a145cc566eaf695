"""Whitening of embeddings by the singular values of their centred rows.

Entries are read as whole numbers, x = floor(64 * c) + 1000000. The fit list holds each distinct x vector once, so that
copies do not pull the axes towards themselves. Spark MLlib's computeSVD takes the centred rows of the fit list as a
distributed matrix (its Gram matrix is summed in a tree, d * d numbers whatever the rows); a singular value s gives the
eigenvalue s^2 / n of the covariance with divisor n. The total variance does not come from the singular values: it is
the exact sum of squared deviations (n*x - S)^2, in whole numbers, over n^3. A last pass over the fit list sums the
products of the whitened rows, whose distance from the identity is reported.

Defined results: rows whose vector is null or empty, or holds a null, an infinite value, NaN or an entry of 2^46 or more
(whose x is no longer exact in a double) are dropped; of vectors of several lengths the commonest length stays (the longer
of two equally common); an eigenvalue within rounding of zero (d * 2^-50 of the largest) has no component, so one distinct
vector alone gives no rows; repeated rows, equal and null ids get rows of their own; a sum of squares that no long holds
is null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.session import materialize, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LIMIT = float(2**46)
#: Rows of a matrix in a Python worker at a time.
ROWS = 2048
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_numbers(vector: Column) -> Column:
    """The vector as longs; null if it is empty or an entry is null, not finite or too large."""
    good = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False)) & ~F.isnan(c))
    return F.when((F.size(vector) > 0) & good, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows with a usable vector of the commonest length."""
    got = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), whole_numbers(F.col(vector_col)).alias("x")).where("x is not null")
    common = got.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    return got.where(F.size("x") == (common["d"] if common else 0))


class Moments:
    """Number of vectors and exact sums of each dimension; deviations n*x - S by whole part and rest of the mean."""

    def __init__(self, fit: DataFrame):
        halves = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.shiftright("v", 20)).alias("hi"), F.sum(F.col("v").bitwiseAND(F.lit((1 << 20) - 1))).alias("lo"), F.max("v").alias("top"), F.min("v").alias("low"))
        got = halves.orderBy("i").collect()  # one row for each dimension
        self.n = got[0]["n"] if got else 0
        self.sums = [(r["hi"] << 20) + r["lo"] for r in got]
        self.whole = [s // self.n for s in self.sums]
        self.rest = [s % self.n for s in self.sums]
        far = max((max(r["top"] - m, m - r["low"]) + 1 for r, m in zip(got, self.whole, strict=True)), default=0)
        #: Whether every sum of squared deviations is known to fit a long.
        self.narrow = len(got) * (self.n * far) ** 2 < 2**63

    def off(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exactly."""
        if not self.narrow:
            return (x.astype(object) - np.array(self.whole, object)) * self.n - np.array(self.rest, object)
        return (x - np.array(self.whole, np.int64)) * self.n - np.array(self.rest, np.int64)

    def centred(self, x: Column) -> Column:
        """x - S/n as doubles, in the JVM."""
        whole, rest = F.array(*map(F.lit, self.whole)), F.array(*[F.lit(r / self.n) for r in self.rest])
        return F.zip_with(F.zip_with(x, whole, lambda a, m: (a - m).cast("double")), rest, lambda a, r: a - r)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def axes(fit: DataFrame, m: Moments, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(d x k unit vectors, k eigenvalues), largest first: right singular vectors of the centred rows, s^2 / n."""
    d = len(m.sums)
    rows = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(m.centred(F.col("x"))).alias("v")), "v")
    svd = RowMatrix(rows, numRows=m.n, numCols=d).computeSVD(d, computeU=False, rCond=1e-9)  # all d: the direct solver, no iteration
    e = np.array(svd.s.toArray()) ** 2 / m.n
    v = svd.V.toArray()
    good = (e > e[0] * d * 2.0**-50) & (e > 0)
    return v[:, good][:, :k], e[good][:k]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), `components` rows for each usable row."""
    spark = rows.sparkSession
    given = usable(rows, id_col, vector_col)
    fit = materialize(given.select("x").distinct(), "fit-list")
    m = Moments(fit)
    if not m.n:
        return spark.createDataFrame([], SCHEMA)
    d, n = len(m.sums), m.n
    v, e = axes(fit, m, components)
    k = len(e)
    if not k:
        return spark.createDataFrame([], SCHEMA)
    turn = v / np.sqrt(e)

    def white(off: np.ndarray) -> np.ndarray:
        return (off.astype(np.float64) / n) @ turn

    def sums(batches):
        products, first, squares = np.zeros((k, k)), np.zeros(k), 0
        for b in _blocks(batches):
            off = m.off(_matrix(b.column(0), d))
            w = white(off)
            products += w.T @ w
            first += w.sum(0)
            squares += sum(map(int, (off * off).sum(1)))
        values = np.concatenate([products.ravel(), first])
        yield pa.RecordBatch.from_arrays([pa.array([list(values)], pa.list_(pa.float64())), pa.array([[int(p) for p in _limbs(squares)]], pa.list_(pa.int64()))], ["parts", "limbs"])

    told = fit.mapInArrow(sums, "parts array<double>, limbs array<bigint>")
    told = materialize(told, "whitened-sums")
    parts = [r["s"] for r in told.select(F.posexplode("parts").alias("i", "p")).groupBy("i").agg(F.sum("p").alias("s")).orderBy("i").collect()]
    limbs = [r["s"] for r in told.select(F.posexplode("limbs").alias("i", "p")).groupBy("i").agg(F.sum("p").alias("s")).orderBy("i").collect()]
    mean = np.array(parts[k * k :]) / n
    error = float(np.abs(np.array(parts[: k * k]).reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    squares = sum(int(x) << (LIMB * i) for i, x in enumerate(limbs))
    trace = squares / n**3  # whole numbers until this division
    share = e / trace
    number = np.arange(1, k + 1, dtype=np.int32)

    def project(batches):
        for b in _blocks(batches):
            off = m.off(_matrix(b.column(1), d))
            dev = [x if x < 2**63 else None for x in map(int, (off * off).sum(1))]
            r = b.num_rows
            by = pa.array(np.repeat(np.arange(r), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(by), pa.array(np.tile(number, r)), pa.array(np.full(r * k, n)), pa.array(dev, pa.int64()).take(by), pa.array(white(off).ravel()), pa.array(np.tile(share, r)), pa.array(np.full(r * k, error))],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return given.mapInArrow(project, SCHEMA)


LIMB = 30


def _limbs(x: int, count: int = 8) -> list[int]:
    """A whole number as digits of 30 bits, which add up as longs; the last holds all above."""
    return [(x >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(count - 1)] + [x >> (LIMB * (count - 1))]


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
