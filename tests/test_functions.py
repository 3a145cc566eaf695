"""Cases with hand-computed results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplework.functions import text as T
from ripplework.functions import vector as V
from ripplework.operators import core as O


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(cols)]).first()


def test_answers(spark):
    lit = F.lit
    r = one(spark, T.last_choice(lit("A then #### c")), T.first_choice(lit("The answer is (B)")), T.answer_format(lit("  ")), T.gold_number(lit("1 #### 2, 3")), T.canonical_number(lit("-0.0")), T.canonical_number(lit("1,200.50")), T.numeric_answer(lit("x"), True), T.solution(lit("none")))
    assert list(r) == ["C", "B", "empty", "3", "0", "1200.5", "", "N/A"]


def test_same_answer(spark):
    lit = F.lit
    r = one(spark, T.same_answer(lit("1/2"), lit("0.5")), T.same_answer(lit("$1,000."), lit("1000")), T.same_answer(lit("Yes"), lit("yes")), T.same_answer(lit("1/0"), lit("2")))
    assert list(r) == [True, True, True, False]


def test_unicode_space(spark):
    r = one(spark, T.fingerprint(F.lit("A 　b ")), T.fingerprint(F.lit("a b")), T.clean_lines(F.lit(" a \r\n\n b ")))
    assert r[0] == r[1] and r[2] == "a\nb"


def test_forces(spark):
    p = F.array(*map(F.lit, (0.2, 0.5, 0.3)))
    r = one(spark, V.force(p, F.lit(1)), V.force_norm(p, F.lit(1)), V.mass_force(p, F.array(F.lit(0), F.lit(2))), V.label_rank(p, F.lit(2), 1), V.argmax(p))
    assert r[0] == pytest.approx([-0.2, 0.5, -0.3]) and r[1] == pytest.approx(0.38)
    assert r[2] == pytest.approx([0.2, -0.5, 0.3]) and r[3] == 2 and r[4] == 1


def test_zero_vector(spark):
    z, x = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))
    r = one(spark, V.cosine(z, x), V.norm_ratio(x, z), V.relative_change(F.lit(1.0), F.lit(0.0)))
    assert r[0] == 0.0 and r[1] is None and r[2] is None


def test_subarray(spark):
    a = F.array(*map(F.lit, (5, 1, 2, 1, 2)))
    r = one(spark, T.subarray_end(a, F.array(F.lit(1), F.lit(2))), T.subarray_end(a, F.array(F.lit(9))))
    assert list(r) == [3, -1]


def test_mask_round_trip(spark):
    texts = ["see `x` and $1$ then `y`", "", "[[KEEP_0001]] `a``b` [[KEEP_9]]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    m = df.select("i", T.mask_spans(F.col("t"), [r"`[^`]*`", r"\$[^$]*\$"]).alias("m")).select("i", "m.*", T.unmask_spans(F.col("m.masked"), F.col("m.kept")).alias("back")).orderBy("i").collect()
    assert [r["back"] for r in m] == texts
    assert m[0]["masked"] == "see [[KEEP_0000]] and [[KEEP_0001]] then [[KEEP_0002]]" and m[2]["kept"] == ["[[KEEP_0001]]", "`a``b`"]
    moved = one(spark, T.unmask_spans(F.lit("b [[KEEP_0001]] a [[KEEP_0000]] [[KEEP_0007]]"), F.array(F.lit("x"), F.lit("y"))))
    assert moved[0] == "b y a x [[KEEP_0007]]"


def test_layers_and_channels():
    assert T.parse_layers("0,-1,last", 4) == [0, 3] and T.parse_channels("both") == ["rh", "gh"]
    with pytest.raises(ValueError):
        T.parse_layers("4", 4)


def test_unequal_keys_raise(spark):
    a, b = spark.range(3), spark.range(1, 4)
    with pytest.raises(Exception, match="key sets differ"):
        O.join_equal_keys(a, b, "id").collect()


def test_constant_correlation(spark):
    assert spark.range(5).select(O.safe_corr(F.lit(1.0), F.col("id").cast("double"))).first()[0] is None


def test_prefix_sum(spark):
    df = spark.range(1000).select(F.col("id").alias("o"), (F.col("id") % 7).alias("v"), (F.col("id") % 2).alias("g"))
    rows = O.prefix_sum(df, "o", "v", ("g",)).collect()
    for g in (0, 1):
        v = [r for r in sorted(rows, key=lambda r: r["o"]) if r["g"] == g]
        assert [r["before"] for r in v] == list(np.cumsum([0] + [r["v"] for r in v])[:-1])


def test_p_value():
    assert O._beta_p(0.5, 27) == pytest.approx(0.00793, abs=2e-5)
    assert O._beta_p(0.0, 10) == pytest.approx(1.0) and O._beta_p(1.0, 10) == 0.0


def test_bootstrap_brackets_mean(spark):
    m = spark.range(400).select((F.col("id") % 20).alias("r"), F.floor(F.col("id") / 20).alias("c"), (F.col("id") % 20 + F.floor(F.col("id") / 20)).cast("double").alias("v"))
    b = O.cluster_bootstrap(m, "r", "c", "v", draws=100).first()
    assert b["lo"] < b["mean"] < b["hi"] and b["mean"] == pytest.approx(19, abs=1)


@pytest.mark.parametrize("rows", [1, 5, 1_000_000])
def test_prefix_sum_on_several_levels(spark, rows, monkeypatch):
    """Ranges of ranges of ranges; a row a range."""
    monkeypatch.setattr(O, "CELLS", 2)
    rng = random.Random(rows)
    table = [(i, rng.choice("ab"), rng.randrange(9)) for i in range(80)]
    rng.shuffle(table)
    got = {r["o"]: r["before"] for r in O.prefix_sum(spark.createDataFrame(table, "o int, g string, v int"), "o", "v", ("g",), rows).collect()}
    assert got == {o: sum(v for p, h, v in table if h == g and p < o) for o, g, _ in table}


def test_fold_in_blocks():
    v, r, want = np.random.default_rng(1).normal(size=1000), 0.0, []
    for x in v:
        r = 0.9 * r + x
        want.append(r)
    for n in (0, 1, 127, 128, 129, 1000):
        assert np.allclose(O._fold(v[:n], 0.9), want[:n], rtol=1e-12, atol=1e-12)
    assert np.allclose(O._fold(v, 0.0), v)


@pytest.mark.parametrize("d", [5, 64, 1024])
def test_spectrum_of_wide_and_many_vectors(spark, d):
    rng = np.random.default_rng(d)
    groups = {"many": rng.normal(size=(3 * d if d < 1024 else 1100, d)) * np.linspace(1e-4, 1, d), "few": rng.normal(size=(3, d)), "zero": np.zeros((4, d)), "one": rng.normal(size=(1, d))}
    df = spark.createDataFrame([(g, x.tolist()) for g, m in groups.items() for x in m] + [("few", None)], "g string, v array<double>").repartition(7)
    got = {r["g"]: r for r in O.effective_rank(df, "g", "v", fan=2, rows=100).collect()}
    assert set(got) == set(groups)
    for g, m in groups.items():
        lam = np.linalg.svd(m, compute_uv=False) ** 2
        p = lam[lam > 1e-12 * lam.sum()] / lam.sum() if lam.sum() else lam[:0]
        want = (lam.sum(), lam[-1] if len(m) <= d else 0.0, lam[0], np.exp(-(p * np.log(p)).sum()) if len(p) else 0.0)
        assert tuple(got[g])[1:] == pytest.approx(want, rel=1e-8, abs=1e-12)


def test_effective_rank(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0])], "g int, v array<double>")
    r = O.effective_rank(df, "g", "v").first()
    assert r["effective_rank"] == pytest.approx(2.0) and r["trace"] == pytest.approx(2.0)


def test_softmax_is_stable(spark):
    p = one(spark, V.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))[0]
    assert p == [0.5, 0.5] and not any(map(math.isnan, p))


def test_retokenise(spark):
    docs = [(i, f"s{i % 2}", [f"w{i}"] * (i % 4)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tok array<string>")
    out = O.retokenise(df, "doc_id", "tok", "source", lambda w: F.split(F.array_join(w, " "), ""), 7, "|").collect()
    stream = [(c, s) for _, s, w in docs for c in [*(list(" ".join(w)) or [""]), "|"]]
    want = [stream[i : i + 7] for i in range(0, len(stream) - 6, 7)]
    got = {r["chunk_index"]: (r["token_ids"], r["label"]) for r in out}
    assert len(got) == len(want)
    for i, w in enumerate(want):
        labels = {s for _, s in w}
        assert got[i] == ([c for c, _ in w], labels.pop() if len(labels) == 1 else "mixed")


def test_bootstrap_line(spark):
    rows = [("g", i, float(i), 3.0 + 2.0 * i + (-1) ** i) for i in range(1, 200)] + [("flat", i, 1.0, 2.0) for i in range(9)] + [("g", -1, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, k bigint, x double, y double")
    (r,) = O.bootstrap_line(df, "g", "k", "x", "y", [10.0]).collect()  # no line without spread in x
    slope, start = np.polyfit([x[2] for x in rows[:199]], [x[3] for x in rows[:199]], 1)
    assert abs(r["fit"] - (start + slope * 10)) < 1e-9 and r["lo"] < r["fit"] < r["hi"] < r["lo"] + 1
    power = spark.createDataFrame([("g", i, float(i), 5.0 * i**1.5) for i in range(1, 50)] + [("g", 0, 0.0, 0.0)], "g string, k bigint, x double, y double")
    (r,) = O.bootstrap_line(power, "g", "k", "x", "y", [4.0], log=True).collect()
    assert abs(r["fit"] - 40) < 1e-9 and abs(r["lo"] - 40) < 1e-9


def test_rounded_as_twins_do(spark):
    """Quotients a bit off a half: 37.5915 scaled is 37591.5, though the double lies below it; 64.9425 lies above, its product below."""
    import duckdb

    rng = random.Random(4)
    xs = [x / n for n in (2, 4, 8, 10, 20, 40, 64, 128) for x in (rng.randrange(-(10**6), 10**6) / 100 for _ in range(200))]
    xs += [0.3046875, 39 / 128, -37.5915, 0.0, -0.0005]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(V.rounded(F.col("x"), 3)).collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 3)", [xs]).fetchall()]
    assert got == want
    by_digits = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(F.round("x", 3)).collect()]
    assert by_digits != want
