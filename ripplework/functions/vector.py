"""Array and vector expressions: products, norms, softmax, forces, entropy. All are Column -> Column, JVM-side, in doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Dense dot product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_wide(a: Column, b: Column, n: int) -> Column:
    """The same for a known width, unrolled: stays in generated code, for pair joins."""
    return reduce(lambda s, i: s + F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double"), range(n), F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def norm_ratio(a: Column, b: Column, eps: float = 1e-30) -> Column:
    """|a| / |b|, null if |b| vanishes."""
    return F.when(norm(b) > eps, norm(a) / norm(b))


def cosine_of(product: Column, na: Column, nb: Column, eps: float = 1e-12) -> Column:
    """Cosine from a product and two norms, with a norm floor, within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product / (F.greatest(na, F.lit(eps)) * F.greatest(nb, F.lit(eps)))))


def cosine(a: Column, b: Column) -> Column:
    return cosine_of(dot(a, b), norm(a), norm(b))


def centred(v: Column) -> Column:
    """The vector less its own mean."""
    return F.zip_with(doubles(v), F.array_repeat(total(doubles(v)) / F.size(v), F.size(v)), lambda x, m: x - m)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    """x / sqrt(mean x^2 + eps)."""
    return F.zip_with(doubles(v), F.array_repeat(F.sqrt(dot(v, v) / F.size(v) + eps), F.size(v)), lambda x, s: x / s)


def softmax(v: Column) -> Column:
    """Shifted by the maximum."""
    e = F.zip_with(doubles(v), F.array_repeat(F.array_max(doubles(v)), F.size(v)), lambda x, m: F.exp(x - m))
    return F.zip_with(e, F.array_repeat(total(e), F.size(v)), lambda x, s: x / s)


def log_sum_exp(v: Column) -> Column:
    m = F.array_max(doubles(v))
    return m + F.ln(total(F.zip_with(doubles(v), F.array_repeat(m, F.size(v)), lambda x, y: F.exp(x - y))))


def force(p: Column, target: Column) -> Column:
    """onehot(target) - p."""
    return F.transform(p, lambda x, i: F.when(i == target, F.lit(1.0)).otherwise(F.lit(0.0)) - x)


def mass_force(p: Column, allowed: Column) -> Column:
    """p restricted to the allowed ids and renormalised, less p; null without mass."""
    mass = total(F.transform(p, lambda x, i: F.when(F.array_contains(allowed, i), x).otherwise(0.0)))
    return F.when(mass > 0, F.transform(p, lambda x, i: F.when(F.array_contains(allowed, i), x / mass).otherwise(0.0) - x))


def force_norm(p: Column, target: Column) -> Column:
    """|onehot - p|^2 = 1 - 2 p_y + sum p^2."""
    return F.lit(1.0) - F.lit(2.0) * F.get(p, target) + dot(p, p)


def transmission(wtg2: Column, g2: Column) -> Column:
    """|W'g|^2 / max(|g|^2, 1e-12)."""
    return wtg2 / F.greatest(g2, F.lit(1e-12))


def entropy(p: Column, eps: float = 1e-10) -> Column:
    return -total(F.transform(p, lambda x: x * F.ln(x + eps)))


def top(v: Column, k: int) -> Column:
    return F.slice(F.sort_array(doubles(v), asc=False), 1, k)


def topk_entropy(logits: Column, k: int) -> Column:
    """Entropy of the k largest logits after their own softmax."""
    return entropy(softmax(top(logits, k)))


def normalised_entropy(p: Column) -> Column:
    """Entropy of p / sum p over ln n; zero entries count nothing."""
    s = total(p)
    q = F.filter(F.transform(p, lambda x: x / s), lambda x: x > 0)
    return F.when(s > 0, -total(F.transform(q, lambda x: x * F.ln(x))) / F.ln(F.size(p).cast("double")))


def label_rank(p: Column, target: Column, k: int) -> Column:
    """1 + the number of entries over the target's, k + 1 if beyond k."""
    at = F.get(p, target)
    return F.least(F.lit(1) + F.size(F.filter(p, lambda x: x > at)), F.lit(k + 1))


def margin(p: Column) -> Column:
    """Largest less second largest."""
    t = top(p, 2)
    return F.get(t, F.lit(0)) - F.get(t, F.lit(1))


def argmax(p: Column) -> Column:
    """The first place of the maximum."""
    return F.array_position(p, F.array_max(p)) - 1


def hoyer(n: Column, l1: Column, l2sq: Column) -> Column:
    """Sparsity (sqrt n - l1 / l2) / (sqrt n - 1); 0 for one entry or none."""
    r = F.sqrt(n.cast("double"))
    return F.when((n > 1) & (l2sq > 0), (r - l1 / F.sqrt(l2sq)) / F.nullif(r - 1, F.lit(0.0))).otherwise(F.lit(0.0))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def replace_infinite(x: Column, big: float = 1e30) -> Column:
    """NaN to 0, infinities to the bound."""
    return F.greatest(F.lit(-big), F.least(F.lit(big), F.nanvl(x, F.lit(0.0))))


def relative_change(v: Column, base: Column) -> Column:
    """(v - base) / base; null for base 0."""
    return (v - base) / F.nullif(base, F.lit(0.0))


def pad(a: Column, n: int, value) -> Column:
    """Cut or padded to n entries."""
    return F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(n) - F.size(a))))


def rounded(x: Column, digits: int) -> Column:
    """To so many digits as C and SQL engines do, scaled first and halves away from zero.

    Spark's own round takes the shortest decimal form instead, and so goes the other way where a quotient lies a bit off a half.
    """
    return F.round(x * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def close(a: Column, b: Column, rel: float = 1e-6, tol: float = 1e-9) -> Column:
    """Equal within a relative or absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(tol))


def linear_factor(delta_dot: Column, input_dot: Column, bias: Column) -> Column:
    """A linear module's product: deltas' dot times inputs' dot, and the deltas' once more where there is a bias."""
    return delta_dot * input_dot + F.when(bias, delta_dot).otherwise(F.lit(0.0))
