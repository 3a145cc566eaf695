"""Queries on token positions: selection, shifts, padding, vocabularies, pooled vectors, baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplework.functions import vector as V
from ripplework.operators import core as O
from ripplework.operators import positions as P
from ripplework.plans.registry import query
from ripplework.plans.texts import DUCK_TOKENS, tokens
from ripplework.session import table

#: Labels and mask of a message stand on its characters' count: every third label is ignored, every seventh masked.
_SEQ = "(SELECT conv_id, turn, list_transform(range(0, len(text) % 40), lambda i: CASE WHEN i % 3 = 1 THEN -100 ELSE i END) AS labels, list_transform(range(0, len(text) % 40), lambda i: CASE WHEN i % 7 = 5 THEN 0 ELSE 1 END) AS mask FROM conversations)"


def _sequences(spark, d):
    n = F.length("text") % 40
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    x = table(spark, d, "conversations").select("conv_id", "turn", at.alias("at"))
    return x.select("conv_id", "turn", F.transform("at", lambda i: F.when(i % 3 == 1, -100).otherwise(i)).alias("labels"), F.transform("at", lambda i: F.when(i % 7 == 5, 0).otherwise(1)).alias("mask"))


@query(f"SELECT conv_id, turn, array_to_string(list_filter(range(1, len(labels)), lambda p: labels[p + 1] <> -100 AND mask[p + 1] <> 0)[1:4], ',') AS positions FROM {_SEQ}")
def supervised_positions(spark, d):
    """labelled, unmasked positions from 1 on, four at most."""
    p = P.supervised_positions(F.col("labels"), F.col("mask"), 4)
    return _sequences(spark, d).select("conv_id", "turn", F.array_join(F.transform(p, lambda i: i.cast("string")), ",").alias("positions"))


@query("SELECT l_orderkey AS seq, l_linenumber AS pos, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, p FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_linenumber) AS r, count(*) OVER (PARTITION BY l_orderkey) AS k FROM (SELECT l_orderkey, l_linenumber, round(min(l_discount + l_tax), 2) AS p FROM lineitem GROUP BY 1, 2)) WHERE r <= greatest(1, ceil(k * 0.3::DOUBLE))) GROUP BY 1, 2")
def low_likelihood_positions(spark, d):
    """the 30 % least likely positions of each sequence."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos")).agg(F.round(F.min(F.col("l_discount") + F.col("l_tax")), 2).alias("p"))
    return P.low_likelihood(x, "seq", "pos", "p", 0.3).groupBy("seq", "pos").agg(F.count("*").alias("n"))


#: A reply in tokens of three characters with one or two answer markers.
_REPLY = "(SELECT o_orderkey AS k, r, list_transform(range(0, (len(r) + 2) // 3), lambda i: substr(r, (i * 3 + 1)::INT, 3)) AS toks FROM (SELECT o_orderkey, 'sum of ' || o_custkey || CASE o_orderkey % 4 WHEN 0 THEN ' #### 1 so #### ' || o_custkey WHEN 1 THEN ' ####' || o_shippriority WHEN 2 THEN ' Answer: 7 ####   ' || o_custkey ELSE ' none' END AS r FROM (SELECT *, 0 AS o_shippriority FROM orders)))"


def _replies(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    end = F.when(k % 4 == 0, F.concat(F.lit(" #### 1 so #### "), c)).when(k % 4 == 1, " ####0").when(k % 4 == 2, F.concat(F.lit(" Answer: 7 ####   "), c)).otherwise(" none")
    r = F.concat(F.lit("sum of "), c, end)
    x = table(spark, d, "orders").select(k.alias("k"), r.alias("r"))
    return x.withColumn("toks", F.transform(F.sequence(F.lit(0), F.floor((F.length("r") + 2) / 3).cast("int") - 1), lambda i: F.substring(F.col("r"), i * 3 + 1, F.lit(3))))


@query(f"""WITH m AS (SELECT k, r, len(toks) AS n, len(r) - instr(reverse(r), '####') + 1 AS stop, contains(r, '####') AS has FROM {_REPLY}),
a AS (SELECT *, stop + len(r[stop + 1:]) - len(ltrim(r[stop + 1:])) AS begin FROM m)
SELECT k, n AS every, 0 AS first, CASE WHEN has AND begin // 3 < n THEN (begin // 3)::INT END AS answer FROM a""")
def update_tokens(spark, d):
    """all supervised tokens, the first, and the first of the final answer behind the last marker."""
    at = F.transform("toks", lambda t, i: i)
    pick = lambda mode: P.update_positions(at, F.col("toks"), mode, ("####", "Answer:"))
    return _replies(spark, d).select("k", F.size(pick("all_supervised")).cast("bigint").alias("every"), F.get(pick("first_response_token"), F.lit(0)).alias("first"), F.get(pick("first_final_answer_token"), F.lit(0)).alias("answer"))


@query(f"SELECT k, len(list_filter(range(1, len(toks)), lambda i: least(i * 3 + 3, len(r)) > 9)) AS targets, CASE WHEN len(r) > 9 AND greatest(1, 3) - k % 5 >= 0 THEN (3 - k % 5)::INT END AS answer FROM {_REPLY}")
def offset_targets(spark, d):
    """tokens that end behind a prompt of nine characters; the first of them after cuts from the left."""
    ends = F.transform("toks", lambda t, i: F.least((i + 1) * 3, F.length("r")))
    x = _replies(spark, d).withColumn("ends", ends)
    return x.select("k", F.size(P.target_positions(F.col("ends"), F.lit(9))).cast("bigint").alias("targets"), P.answer_position(F.col("ends"), F.lit(9), F.col("k") % 5).cast("int").alias("answer"))


@query("SELECT user_id, event_id AS pos, round(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS score FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS event_id, value FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1")
def causal_shift(spark, d):
    """Each position is scored by the one before; position 0 by none."""
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.lit(1).cast("bigint").alias("one"))
    e = O.prefix_sum(e, "event_id", "one", ("user_id",), out="pos")
    x = P.causal(e, "user_id", "pos", "value", "score").withColumn("logit_pos", F.col("pos") - 1)
    x = O.require(x, P.misaligned(F.col("pos"), F.col("logit_pos")), "misaligned")
    return x.select("user_id", "pos", F.round("score", 6).alias("score"))


@query(f"SELECT conv_id, turn, array_to_string(list_concat(labels[1:16], list_transform(range(0, greatest(0, 16 - len(labels))), lambda i: -100)), ',') AS padded, array_to_string(labels[greatest(len(labels) - 16, 0) + 1:], ',') AS tail FROM {_SEQ}")
def padded_labels(spark, d):
    """Labels cut or padded to 16, and cut from the left so that the completion stays."""
    s = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    x = F.col("labels")
    return _sequences(spark, d).select("conv_id", "turn", s(V.pad(x, 16, -100)).alias("padded"), s(P.trimmed_left(x, 16)).alias("tail"))


@query("SELECT DISTINCT unnest(list_transform(list_sort(list_transform(range(0, 64), lambda i: {'x': -embedding[i + 1]::DOUBLE, 'i': i}))[1:3], lambda r: r.i))::INT AS id FROM embeddings WHERE label = 3")
def batch_vocabulary(spark, d):
    """Ids among the three largest entries of one class's rows."""
    return P.batch_vocabulary(table(spark, d, "embeddings").where("label = 3"), "embedding", 3)


@query(f"SELECT tok FROM (SELECT unnest({DUCK_TOKENS}) AS tok FROM documents UNION SELECT unnest({DUCK_TOKENS}) FROM benchmark)")
def joint_vocabulary(spark, d):
    """Distinct tokens of documents and benchmark."""
    return P.vocabulary(*[table(spark, d, t).select(tokens().alias("tok")) for t in ("documents", "benchmark")])


_C = "(SELECT vec_id, label, e, list_transform(e, lambda x: x - list_sum(e) / 64) AS c FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))"
_COS = "list_dot_product({0}, {1}) / (greatest(sqrt(list_dot_product({0}, {0})), 1e-12) * greatest(sqrt(list_dot_product({1}, {1})), 1e-12))"


@query(f"SELECT o.vec_id, round(avg(list_dot_product(u.e, o.e)), 5) AS dot_mean, round(sum(list_dot_product(u.e, o.e)), 4) AS dot_sum, round(max(list_dot_product(u.e, o.e)), 5) AS dot_max, round(avg({_COS.format('u.e', 'o.e')}), 6) AS cosine_mean, round(max({_COS.format('u.c', 'o.c')}), 6) AS centred_max FROM {_C} u, {_C} o WHERE u.vec_id % 20 = 0 GROUP BY 1")
def observation_baselines(spark, d):
    """Every row as an observation over the update tokens, which are the ids divisible by 20."""
    e = table(spark, d, "embeddings")
    b = P.observation_baselines(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 64)
    return b.select("vec_id", F.round("dot_mean", 5).alias("dot_mean"), F.round("dot_sum", 4).alias("dot_sum"), F.round("dot_max", 5).alias("dot_max"), F.round("cosine_mean", 6).alias("cosine_mean"), F.round("centred_max", 6).alias("centred_max"))


@query("""WITH t AS (SELECT label AS seq, vec_id AS pos, (vec_id % 3 <> 0) AS m, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT seq, p, sum(CASE WHEN m THEN e[p] ELSE 0 END) / greatest(count(*) FILTER (m), 1) AS x FROM t, (SELECT unnest(range(1, 65)) AS p) GROUP BY 1, 2),
n AS (SELECT seq, sqrt(sum(x * x)) AS n, max(x) FILTER (p = 1) AS x1 FROM d GROUP BY 1),
l AS (SELECT seq, arg_max(e, pos) AS e FROM t WHERE m GROUP BY 1)
SELECT seq, round(x1 / greatest(n, 1e-12), 6) AS mean_first, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS last_first FROM n JOIN l USING (seq)""")
def pooled_embeddings(spark, d):
    """Masked mean and last unmasked token of each sequence, of length 1; a label's rows stand for a sequence."""
    t = table(spark, d, "embeddings").select(F.col("label").alias("seq"), F.col("vec_id").alias("pos"), (F.col("vec_id") % 3 != 0).cast("int").alias("m"), "embedding")
    got = [P.pooled(t, "seq", "pos", "m", "embedding", how).select("seq", F.round(F.get("pooled", F.lit(0)), 6).alias(n)) for how, n in (("mean", "mean_first"), ("last_token", "last_first"))]
    return got[0].join(got[1], "seq")


@query(f"SELECT doc_id, md5(array_to_string({DUCK_TOKENS}[1:50], ' ')) AS h FROM documents")
def truncated_texts(spark, d):
    """The first fifty tokens."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.slice(tokens(), 1, 50), " ")).alias("h"))


@query(f"""WITH t AS (SELECT lang, tok, count(*) AS n, avg(len(tok)) AS g FROM (SELECT lang, unnest({DUCK_TOKENS}) AS tok FROM documents) GROUP BY 1, 2),
r AS (SELECT lang, tok, 'raw' AS support, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tok) AS k FROM t UNION ALL SELECT lang, tok, 'gradient', row_number() OVER (PARTITION BY lang ORDER BY n DESC, tok) FROM t WHERE g > 3 AND g < 9),
s AS (SELECT * FROM r WHERE k <= 100)
SELECT a.lang, count(b.tok) AS shared, round(count(b.tok)::DOUBLE / (count(*) + max(m.n) - count(b.tok)), 6) AS jaccard FROM (SELECT * FROM s WHERE support = 'raw') a LEFT JOIN (SELECT * FROM s WHERE support = 'gradient') b ON a.lang = b.lang AND a.tok = b.tok JOIN (SELECT lang, count(*) AS n FROM s WHERE support = 'gradient' GROUP BY 1) m ON m.lang = a.lang GROUP BY 1""")
def filtered_support(spark, d):
    """The most frequent tokens, and those among tokens whose gradient lies in an interval; a word's length stands for it."""
    t = table(spark, d, "documents").select("lang", F.explode(tokens()).alias("tok")).groupBy("lang", "tok").agg(F.count("*").alias("n"), F.avg(F.length("tok")).alias("g"))
    top = lambda x: O.top_support(x, "lang", "tok", "n", 100)
    a, b = top(t), top(t.where("g > 3 and g < 9"))
    both = a.select("lang", "tok", F.lit(1).alias("a")).join(b.select("lang", "tok", F.lit(1).alias("b")), ["lang", "tok"], "full_outer")
    g = both.groupBy("lang").agg(F.count(F.col("a") + F.col("b")).alias("shared"), F.count("*").alias("n"))
    return g.select("lang", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("jaccard"))
