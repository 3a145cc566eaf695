"""Queries for single functions of the library: text tests, selectors, projections, sources and sinks, resampled bands."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ripplework.functions import text as T
from ripplework.functions import vector as V
from ripplework.operators import core as O
from ripplework.plans.registry import query
from ripplework.plans.relational import _L, pair_layers
from ripplework.plans.vectors import _E, _SCORES, nearest
from ripplework.session import shared_dir, table
from ripplework.sources import io


def _path(spark, name):
    return f"{shared_dir(spark)}/ripplework/{name}-{uuid.uuid4().hex}"


@query("SELECT source, count(*) FILTER (contains(text, '####')) AS marked, count(*) FILTER (contains(lower(text), 'the ')) AS has, count(*) FILTER (starts_with(text, 'T')) AS starts, count(*) FILTER (ends_with(text, '.')) AS ends FROM documents GROUP BY 1")
def contains_flags(spark, d):
    """C31."""
    t = F.col("text")
    tests = {"marked": t.contains("####"), "has": F.lower(t).contains("the "), "starts": t.startswith("T"), "ends": t.endswith(".")}
    return table(spark, d, "documents").groupBy("source").agg(*[F.count_if(c).alias(n) for n, c in tests.items()])


@query(f"SELECT pair, layer, round(e, 6) AS e FROM {_L} WHERE layer IN (1, 6, 3)")
def layer_selection(spark, d):
    """A selector is parsed once and becomes a pushed-down set of values."""
    want = T.parse_layers("3, 1, last", 7)
    return pair_layers(spark, d).where(F.col("layer").isin(want)).select("pair", "layer", F.round("e", 6).alias("e"))


@query(f"SELECT vec_id, round(list_dot_product(e[1:32], e[1:32]), 6) AS rh, round(list_dot_product(e[33:64], e[33:64]), 6) AS gh FROM {_E}")
def channel_energy(spark, d):
    """Halves of each vector stand for the two channels."""
    at = {"rh": 1, "gh": 33}
    e = table(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("e"))
    half = {c: F.slice("e", at[c], 32) for c in T.parse_channels("both")}
    return e.select("vec_id", *[F.round(V.dot(h, h), 6).alias(c) for c, h in half.items()])


@query("""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS w, string_split(text, ' ')[3:4] AS n FROM conversations)
SELECT conv_id, turn, coalesce(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(n)] = n)[1] + len(n), -1)::INT AS after FROM t""")
def subarray_position(spark, d):
    """Where the third and fourth word of a message first stand together (the third alone if there is no fourth)."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    return t.select("conv_id", "turn", T.subarray_end(F.col("w"), F.slice("w", 3, 2)).alias("after"))


_SPANS = r"(?:\[\[KEEP_[0-9]{4,}\]\]|(?:https?://\S+)|(?:\S+@\S+)|(?:\d[\d,.]*))+"


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '[[KEEP_0000]] 5 ' || text ELSE text END AS text FROM documents),
p AS (SELECT doc_id, text, regexp_extract_all(text, '{_SPANS}') AS kept, regexp_split_to_array(text, '{_SPANS}') AS gaps FROM t)
SELECT doc_id, len(kept) AS spans, md5(array_to_string(list_transform(gaps, lambda g, i: g || CASE WHEN i <= len(kept) THEN '[[KEEP_' || lpad((i - 1)::VARCHAR, 4, '0') || ']]' ELSE '' END), '')) AS masked, md5(text) AS restored FROM p""")
def protected_spans(spark, d):
    """Addresses, e-mails, numbers and placeholders that were there are masked, and put back."""
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("[[KEEP_0000]] 5 "), "text")).otherwise(F.col("text"))
    m = table(spark, d, "documents").select("doc_id", T.mask_spans(text, [r"https?://\S+", r"\S+@\S+", r"\d[\d,.]*"]).alias("m"))
    return m.select("doc_id", F.size("m.kept").cast("bigint").alias("spans"), F.md5("m.masked").alias("masked"), F.md5(T.unmask_spans(F.col("m.masked"), F.col("m.kept"))).alias("restored"))


@query(f"""WITH w AS (SELECT label AS id, p, avg(x) AS w FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM {_E}) GROUP BY 1, 2),
g AS (SELECT vec_id, p - 1 AS id, x AS g FROM (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM {_E}) WHERE p <= 10)
SELECT vec_id, round(sum(v * v), 6) AS norm_sq FROM (SELECT vec_id, w.p, sum(g * w) AS v FROM g JOIN w USING (id) GROUP BY 1, 2) GROUP BY 1""")
def readout_projection(spark, d):
    """The first ten entries stand for the gradient over a restricted vocabulary, class means for its readout rows."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode(V.doubles(F.col("embedding"))).alias("p", "x"))
    w = e.groupBy(F.col("label").alias("id"), "p").agg(F.avg("x").alias("w"))
    g = e.where("p < 10").select("vec_id", F.col("p").alias("id"), F.col("x").alias("g"))
    v = g.join(w, "id").groupBy("vec_id", "p").agg(F.sum(F.col("g") * F.col("w")).alias("v"))
    return v.groupBy("vec_id").agg(F.round(F.sum(F.col("v") * F.col("v")), 6).alias("norm_sq"))


@query("""WITH f AS (SELECT user_id, event_type, arg_min(value, event_id) AS p FROM events GROUP BY 1, 2)
SELECT event_id, round(p * value, 6) AS r FROM events JOIN f USING (user_id, event_type)""")
def fixed_force(spark, d):
    """Each series' first probability is frozen and meets the value of every later step."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    first = e.groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("p"))
    return e.join(first, ["user_id", "event_type"]).select("event_id", F.round(F.col("p") * F.col("value"), 6).alias("r"))


@query("WITH r AS (SELECT event_id, exp(value * user_id) AS a, exp(value * (user_id % 7)) AS b FROM events) SELECT event_id, CASE WHEN isnan(a - b) THEN 0.0 WHEN a - b > 1e30 THEN 1e30 WHEN a - b < -1e30 THEN -1e30 ELSE round(sign(a - b) * ln(1 + abs(a - b)), 6) END AS x FROM r")
def finite_values(spark, d):
    """Differences of exponentials, of which many overflow and some are infinite on both sides."""
    x = F.exp(F.col("value") * F.col("user_id")) - F.exp(F.col("value") * (F.col("user_id") % 7))
    big = V.replace_infinite(x)
    return table(spark, d, "events").select("event_id", F.when(F.abs(big) < 1e30, F.round(F.signum(big) * F.log1p(F.abs(big)), 6)).otherwise(big).alias("x"))


@query("SELECT l_orderkey AS pair, round(sum(l_discount * l_quantity + CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 0 END), 6) AS product FROM lineitem GROUP BY 1")
def linear_factors(spark, d):
    """modules' products of deltas and of inputs, with the delta once more where there is a bias."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pair"))
    return x.agg(F.round(F.sum(V.linear_factor(F.col("l_discount"), F.col("l_quantity"), F.col("l_returnflag") == "R")), 6).alias("product"))


@query(f"""WITH t AS (SELECT q, c FROM (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY s DESC, c DESC) AS k FROM {_SCORES}) WHERE k = 1)
SELECT q, c AS memory, md5('Example: ' || m.text || chr(10) || 'Question: ' || n.text) AS prompt FROM t JOIN documents m ON m.doc_id = c JOIN documents n ON n.doc_id = q""")
def memory_prompt(spark, d):
    """The best candidate of each query becomes the example of its prompt."""
    best = nearest(spark, d, "s", 1).select("q", F.col("c").alias("memory"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    j = best.join(docs.toDF("memory", "m"), "memory").join(docs.toDF("q", "n"), "q")
    return j.select("q", "memory", F.md5(F.concat(F.lit("Example: "), "m", F.lit("\nQuestion: "), "n")).alias("prompt"))


@query(f"""WITH t AS (SELECT q, c, ql, cl FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c DESC) AS k FROM {_SCORES}) WHERE k = 1)
SELECT count(*) AS n, round(avg((ql = cl)::INT), 6) AS accuracy, round(avg((q % 3 = c % 3)::INT), 6) AS same_source, round(avg((ql = cl)::INT) FILTER (q % 3 = c % 3), 6) AS accuracy_same, round(avg((ql = cl)::INT) FILTER (q % 3 <> c % 3), 6) AS accuracy_other FROM t""")
def memory_summary(spark, d):
    """The example's label is the answer; how many match, by whether query and example share a source (id mod 3)."""
    best = nearest(spark, d, "s", 1)
    reply, gold = F.concat(F.lit("so #### "), F.col("cl")), F.concat(F.col("ql"), F.lit(".0"))
    right = T.same_answer(T.numeric_answer(reply, True), gold).cast("double")
    same = F.col("q") % 3 == F.col("c") % 3
    return best.agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(same.cast("double")), 6).alias("same_source"), F.round(F.avg(F.when(same, right)), 6).alias("accuracy_same"), F.round(F.avg(F.when(~same, right)), 6).alias("accuracy_other"))


@query("SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def gzip_tsv_round_trip(spark, d):
    """Tab-separated, compressed, read with coercion."""
    path = _path(spark, "tsv")
    table(spark, d, "events").select("user_id", "value").write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    back = io.read_delimited(spark, path, ["user_id", "value"], sep="\t", numeric=("value",))
    return back.groupBy(F.col("user_id").cast("bigint").alias("user_id")).agg(F.round(F.avg("value"), 6).alias("mean"))


@query()
def regression_band(spark, d):
    """A bootstrap band of value on user over the fitted grid; rows-only, since draws come from a hash."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
    return O.bootstrap_line(e, "event_type", "event_id", "x", "y", [0.0, 50.0, 100.0, 150.0])


@query()
def retokenised_chunks(spark, d):
    """Packed words, segment by segment, to packed characters; rows-only, as a hash of each chunk."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    chunks = O.retokenise(docs, "doc_id", words, "source", lambda w: F.filter(F.split(F.array_join(w, " "), ""), lambda x: x != ""), 1024, "</s>")
    return chunks.select("chunk_index", "label", F.md5(F.array_join("token_ids", "")).alias("h"))
