"""Queries on rows as records: messages, candidates, filters, look-ups, zips, reshapes, checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ripplework.functions import text as T
from ripplework.functions import vector as V
from ripplework.operators import core as O
from ripplework.operators import records as R
from ripplework.plans.registry import query
from ripplework.session import PLACE, placed, table

_MD5 = "md5(array_to_string(list_transform({0}, lambda z: z.role || ': ' || z.content), chr(10) || '--' || chr(10)))"


def _digest(messages):
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n--\n"))


@query("""WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)
SELECT doc_id, 2::BIGINT AS n, md5(CASE doc_id % 3
  WHEN 0 THEN 'user: ' || source || chr(10) || '--' || chr(10) || 'assistant: ' || text
  WHEN 1 THEN 'user: Instruction: ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Context: ' || lang ELSE '' END || chr(10) || '--' || chr(10) || 'assistant: ' || text
  ELSE 'user: Write a Python function that solves the following programming task.' || chr(10) || chr(10) || 'Task: ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'The solution should satisfy these tests:' || chr(10) || lang || chr(10) || 'x' ELSE chr(10) || chr(10) || 'Test setup:' || chr(10) || lang END || chr(10) || '--' || chr(10) || 'assistant: ' || text END) AS h FROM d""")
def row_messages(spark, d):
    """Three kinds of rows to messages, by their own columns."""
    x = table(spark, d, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    k, even = F.col("doc_id") % 3, F.col("doc_id") % 2 == 0
    plain = x.where(k == 0).select("doc_id", F.col("source").alias("question"), F.lit("unused").alias("output"), F.col("text").alias("answer"))
    guided = x.where(k == 1).select("doc_id", R.instruction_messages(F.col("source"), F.when(even, F.concat(F.lit(" "), "lang")), F.col("text")).alias("m"))
    tests = F.when(even, F.array("lang", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    tasks = x.where(k == 2).select("doc_id", R.task_messages(F.col("source"), tests, F.when(~even, F.col("lang")), F.col("text")).alias("m"))
    out = plain.select("doc_id", R.pair_messages(plain).alias("m")).union(guided).union(tasks)
    return out.select("doc_id", F.size("m").cast("bigint").alias("n"), _digest(F.col("m")).alias("h"))


@query(f"""WITH c AS (SELECT conv_id, list({{'role': CASE WHEN turn % 5 = 4 THEN '' WHEN role = 'user' THEN 'human' WHEN role = 'assistant' THEN ' GPT ' ELSE role END, 'content': CASE WHEN turn % 7 = 6 THEN '  ' ELSE text END, 'turn': turn}} ORDER BY turn) AS t FROM conversations GROUP BY 1),
m AS (SELECT conv_id, list_filter(list_transform(t, lambda x, i: {{'role': CASE lower(trim(x.role)) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN '' THEN CASE i % 2 WHEN 1 THEN 'user' ELSE 'assistant' END ELSE lower(trim(x.role)) END, 'content': regexp_replace(x.content, '^\\s+|\\s+$', '', 'g')}}), lambda x: x.content <> '') AS m FROM c)
SELECT conv_id, len(m) AS n, len(list_filter(m, lambda x: x.role = 'assistant')) > 0 AS answered, {_MD5.format('m')} AS h FROM m""")
def turn_messages(spark, d):
    """Turns with speakers of other names, nameless ones and blank ones."""
    t = F.col("turn")
    role = F.when(t % 5 == 4, "").when(F.col("role") == "user", "human").when(F.col("role") == "assistant", " GPT ").otherwise(F.col("role"))
    row = F.struct("turn", role.alias("from"), F.when(t % 7 == 6, "  ").otherwise(F.col("text")).alias("value"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t")).withColumn("m", R.turn_messages(F.col("t"), "from", "value"))
    return c.select("conv_id", F.size("m").cast("bigint").alias("n"), R.answered(F.col("m")).alias("answered"), _digest(F.col("m")).alias("h"))


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(list_filter(list_transform(t, lambda x, i: CASE i % 2 WHEN 1 THEN 'u' ELSE 'a' END || len(trim(x))), lambda x: x[2:] <> '0'), ' ') AS said FROM c""")
def plain_turns(spark, d):
    """Turns that are strings, speakers by place."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]).alias("t"))
    m = R.turn_messages(F.transform("t", lambda x: F.trim(x)))
    return c.select("conv_id", F.array_join(F.transform(m, lambda x: F.concat(F.substring(x["role"], 1, 1), F.length(x["content"]).cast("string"))), " ").alias("said"))


@query("""WITH w AS (SELECT doc_id, source, len(string_split(text, ' ')) AS n FROM documents)
SELECT doc_id, n - n // 3 >= 16 AND n // 3 <= 512 - 16 AS fits FROM w""")
def context_window(spark, d):
    """the first third of a document's words is the prompt, the rest the completion."""
    n = F.size(F.split("text", " "))
    p = F.floor(n / 3)
    return table(spark, d, "documents").select("doc_id", R.fits_context(p, n - p, 512).alias("fits"))


@query("SELECT source, count(*) FILTER (coalesce(regexp_replace(CASE WHEN doc_id % 4 = 0 THEN chr(9) || ' ' WHEN doc_id % 4 = 1 THEN NULL ELSE text END, '\\s+', '', 'g'), '') <> '') AS n FROM documents GROUP BY 1")
def not_blank(spark, d):
    """blank and null responses go."""
    c = F.when(F.col("doc_id") % 4 == 0, "\t ").when(F.col("doc_id") % 4 != 1, F.col("text"))
    x = table(spark, d, "documents").groupBy("source")
    return x.agg(F.count_if(R.not_blank(c)).alias("n"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE year(o_orderdate) >= 1996 END AS kept FROM orders")
def year_filter(spark, d):
    """null passes, what is no year does not."""
    k = F.col("o_orderkey")
    y = F.when(k % 5 == 0, None).when(k % 5 == 1, "n.d.").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, d, "orders").select("o_orderkey", R.year_from(y, 1996).alias("kept"))


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM documents WHERE lang IN ('en', 'fr')")
def category_index(spark, d):
    """two categories, each numbered from 0."""
    return R.renumbered(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", ["en", "fr"], "idx")


@query("SELECT doc_id, language, row_number() OVER (ORDER BY doc_id, array_position(['en', 'de', 'fr'], language)) - 1 AS train_index FROM documents, (SELECT unnest(['en', 'de', 'fr']) AS language)")
def candidate_rows(spark, d):
    """Every row times three languages."""
    return R.candidates(table(spark, d, "documents").select("doc_id"), "doc_id", ["en", "de", "fr"])


_LABELS = {"en": ("Question", "Answer"), "de": ("Frage", "Antwort"), "fr": ("Question", "Réponse")}


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 'Frage' ELSE 'Question' END || ': ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || CASE lang WHEN 'de' THEN 'Antwort' WHEN 'fr' THEN 'Réponse' ELSE 'Answer' END || ': ' || doc_id ELSE '' END AS query_text FROM documents")
def query_texts(spark, d):
    """Question and answer, or the question alone, under the language's labels."""
    lang, q = F.col("lang"), F.col("source")
    both = R.query_text(_LABELS, lang, q, F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, both).otherwise(R.query_text(_LABELS, lang, q)).alias("query_text"))


@query("SELECT event_id AS x, value AS y FROM events WHERE event_type = 'click' AND value IS NOT NULL AND event_id % 9 <> 0")
def metric_curve(spark, d):
    """One metric's points without its null rows."""
    e = table(spark, d, "events").where("event_type = 'click'").withColumn("v", F.when(F.col("event_id") % 9 != 0, F.col("value")))
    return R.curve(e, "event_id", "v")


@query("SELECT 'click' AS variant, count(*) AS n, sum(user_id)::BIGINT AS users, NULL::DOUBLE AS total FROM events WHERE event_type = 'click' UNION ALL SELECT 'rest', count(*), NULL, round(sum(value), 4) FROM events WHERE event_type <> 'click'")
def variants_union(spark, d):
    """Two tables under one another, tagged, with columns that only one has."""
    e = table(spark, d, "events")
    a = e.where("event_type = 'click'").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))
    b = e.where("event_type <> 'click'").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return R.tagged({"click": a, "rest": b}, "variant").select("variant", "n", "users", "total")


@query("SELECT vec_id, r::INT AS layer, c::INT AS pair, e[r * 16 + c + 1]::DOUBLE AS value FROM (SELECT vec_id, embedding AS e FROM embeddings), (SELECT unnest(range(0, 4)) AS r), (SELECT unnest(range(0, 16)) AS c)")
def matrix_rows(spark, d):
    """P10: a 4 x 16 matrix of each vector to rows."""
    m = F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)])
    x = R.matrix_rows(table(spark, d, "embeddings").select("vec_id", m.alias("m")), "m", "layer", "pair", "value")
    return x.select("vec_id", "layer", "pair", F.col("value").cast("double").alias("value"))


@query("SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_discount END, l_extendedprice / 1000), 6) AS real, l_tax AS approx, count(*) AS n FROM lineitem GROUP BY ALL")
def canonical_columns(spark, d):
    """The first alternative that is there, row by row; a scaled one; one that no table has."""
    x = table(spark, d, "lineitem").withColumn("exact", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")))
    x = R.canonical(x, {"real": [("missing", 1.0), ("exact", 1.0), ("l_extendedprice", 1000.0)], "approx": [("l_tax", 1.0)]})
    return x.groupBy("l_orderkey", "l_linenumber", F.round("real", 6).alias("real"), "approx").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, 'chat:' || conv_id || '-' || turn AS example_id, 'chat:' || role AS domain FROM conversations")
def sample_ids(spark, d):
    """Ids and domains with their dataset in front."""
    name = lambda c: F.concat(F.lit("chat:"), c)
    return table(spark, d, "conversations").select("conv_id", "turn", name(F.concat_ws("-", "conv_id", "turn")).alias("example_id"), name(F.col("role")).alias("domain"))


@query("SELECT event_id, array_to_string(list_filter(['kind=' || event_type, CASE WHEN user_id % 2 = 0 THEN 'user=' || user_id END], lambda x: x IS NOT NULL), ',') AS kept FROM events")
def metadata_slice(spark, d):
    """Wanted keys of a map, without those that are null."""
    m = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")), F.lit("id"), F.col("event_id").cast("string"))
    kept = F.transform(F.map_entries(R.present(m, ["kind", "user", "none"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, d, "events").select("event_id", F.array_join(kept, ",").alias("kept"))


@query("SELECT l_orderkey, l_linenumber AS task, min((l_linenumber - 1) * 3 + l_quantity % 3) AS continuous_epoch, min(l_orderkey * 100 + l_quantity)::DOUBLE AS global_step FROM lineitem GROUP BY 1, 2")
def running_coordinates(spark, d):
    """Keys renamed, epochs and steps counted on over segments."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") % 3).alias("epoch"), F.col("l_quantity").alias("step"), (F.col("l_orderkey") * 100).alias("offset"))
    x = R.running_coordinates(x, {"l_linenumber": "task"}, "l_linenumber", "epoch", "step", 3, "offset")
    return x.groupBy("l_orderkey", "task").agg(F.min("continuous_epoch").alias("continuous_epoch"), F.min("global_step").cast("double").alias("global_step"))


@query("SELECT a.vec_id AS i, a.vec_id // 2 AS j, a.label AS left_label, b.label AS right_label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2")
def pair_metadata(spark, d):
    """Labels of both sides of a pair by dense index."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    p = e.select(F.col("vec_id").alias("i"), F.floor(F.col("vec_id") / 2).alias("j"))
    return R.with_metadata(p, e, "vec_id", "i", "j")


@query("SELECT vec_id, p::INT AS pos, embedding[p + 1]::DOUBLE AS a, embedding[p + 33]::DOUBLE AS b FROM embeddings, (SELECT unnest(range(0, 32)) AS p)")
def zipped_lists(spark, d):
    """Two lists of one length, side by side."""
    x = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).cast("array<double>").alias("a"), F.slice("embedding", 33, 32).cast("array<double>").alias("b"))
    return R.zipped(x, "a", "b")


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%1%' THEN 'one' WHEN p_brand LIKE 'Brand#%' THEN 'brand' ELSE 'other' END AS dataset FROM part")
def name_patterns(spark, d):
    """A name to what the first fitting pattern stands for."""
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_name").contains("1"), F.col("p_name")).otherwise(F.col("p_brand")).alias("n"))
    return R.mapped(x, "n", [("%Brand#%", "brand"), ("%1%", "one"), ("%", "other")]).select("p_partkey", F.when(F.col("n").contains("Brand#"), "brand").otherwise(F.col("dataset")).alias("dataset"))


@query("SELECT o_orderkey AS k, o_orderpriority AS base, lower(o_orderpriority) AS sft, o_orderstatus AS eaft, count(*) OVER () AS n FROM orders")
def three_way_join(spark, d):
    """Three runs by example; of doubled ids the last row counts."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", "o_orderstatus")
    doubled = x.select("k", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("old").alias("base")), F.struct(F.lit(1).alias("pos"), F.col("o_orderpriority").alias("base")))).alias("r")).select("k", "r.*")
    base = O.last_wins(doubled, "k", "pos").select("k", "base")
    j = O.join_equal_keys(base, x.select("k", F.lower("o_orderpriority").alias("sft")), "k")
    j = O.join_equal_keys(j, x.select("k", F.col("o_orderstatus").alias("eaft")), "k")
    return j.crossJoin(F.broadcast(j.agg(F.count("*").alias("n"))))  # one row


@query("SELECT doc_id, md5(source) AS target, 'Q: ' || source AS left_prompt, 'Problem: ' || source AS right_prompt FROM documents")
def paired_variants(spark, d):
    """Two prompt forms of the same examples; target and source must agree."""
    x = table(spark, d, "documents").select("doc_id", F.md5("source").alias("target"), "source")
    a, b = (x.select("doc_id", "target", F.concat(F.lit(p), "source").alias("prompt")) for p in ("Q: ", "Problem: "))
    return R.paired_variants(a, b, "doc_id", ["target"]).select("doc_id", F.col("left_target").alias("target"), "left_prompt", "right_prompt")


@query("SELECT label, array_to_string(list(target || '=' || n ORDER BY target), ',') AS counts FROM (SELECT label, vec_id % 3 AS target, count(*) AS n FROM embeddings GROUP BY 1, 2) GROUP BY 1")
def target_counts(spark, d):
    """Counts of targets as a map for each subject."""
    x = R.counts_map(table(spark, d, "embeddings").select("label", (F.col("vec_id") % 3).alias("target")), "label", "target")
    return x.select("label", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def sized_groups(spark, d):
    """Every region has five nations, or the query fails."""
    return R.sized_groups(table(spark, d, "nation").select(F.col("n_regionkey").alias("region")), "region", 5)


@query("SELECT l_linenumber AS layer, count(c) AS n, round(avg(c), 6) AS mean, round(median(c), 6) AS median, round(avg(r), 6) AS ratio FROM (SELECT l_linenumber, CASE WHEN l_orderkey % 11 <> 0 THEN l_discount END AS c, CASE WHEN l_tax > 0 THEN l_discount / l_tax END AS r FROM lineitem) GROUP BY 1")
def trace_summary(spark, d):
    """Means and medians by layer that pass over what is no number."""
    c = F.nullif(F.when(F.col("l_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")), F.lit(float("nan")))
    r = F.try_divide(F.col("l_discount"), F.nullif(F.col("l_tax"), F.lit(0.0)))
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("layer")).agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.percentile(c, F.lit(0.5)), 6).alias("median"), F.round(F.avg(r), 6).alias("ratio"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY array_position(['O', 'F', 'P'], o_orderstatus), o_totalprice DESC, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END ASC NULLS LAST, o_orderkey) - 1 AS place FROM orders")
def mixed_sort(spark, d):
    """Levels in a given order, one key descending, nulls last; places by prefix sums of ranges, not one window."""
    level = F.array_position(F.array(*map(F.lit, "OFP")), F.col("o_orderstatus"))
    key = F.struct(level.alias("a"), (-F.col("o_totalprice")).alias("b"), F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")), F.lit(2**62)).alias("c"), F.col("o_orderkey").alias("d"))
    return O.numbered(table(spark, d, "orders").select("o_orderkey", key.alias("key"), level.cast("double").alias("coarse")), "key", "place").select("o_orderkey", "place")


@query("SELECT array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents")
def distinct_sorted(spark, d):
    """Distinct values in order, of columns with few."""
    s = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    x = table(spark, d, "documents").select("lang", "source").distinct()
    return x.agg(s("lang").alias("langs"), s("source").alias("sources"))


@query("SELECT user_id, arg_max(event_type || event_id, (ts, event_type || event_id)) AS newest FROM events GROUP BY 1")
def latest_candidate(spark, d):
    """What was modified last, ties to the greater name."""
    x = table(spark, d, "events").select("user_id", "ts", F.concat("event_type", "event_id").alias("newest"))
    return R.latest(x, "user_id", "newest", "ts")


@query("SELECT doc_id, source FROM (SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('17:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 4 ORDER BY md5('17:' || source || ':' || doc_id), doc_id LIMIT 30)")
def domain_sample(spark, d):
    """Four of each domain, thirty in all."""
    return R.sample_by_domain(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 4, 30, 17)


@query("SELECT vec_id AS pos, vec_id AS declared, CASE WHEN vec_id % 50 = 7 THEN vec_id + 1 WHEN vec_id % 50 = 9 THEN NULL ELSE vec_id END AS found FROM embeddings WHERE vec_id % 50 IN (7, 9)")
def order_equality(spark, d):
    """Where a list of indices is not the declared one."""
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").alias("index"))
    b = a.where("pos % 50 <> 9").withColumn("index", F.when(F.col("pos") % 50 == 7, F.col("index") + 1).otherwise(F.col("index")))
    return R.same_order(a, b, "pos", "index")


@query("""WITH m AS (SELECT event_type AS run, avg(value) AS mean, count(*)::DOUBLE AS n FROM events GROUP BY 1), l AS (SELECT run, 'mean' AS metric, mean AS v FROM m UNION ALL SELECT run, 'n', n FROM m)
SELECT run, metric, CASE WHEN metric = 'n' THEN true ELSE run <> 'click' END AS ok FROM l""")
def recomputed_metrics(spark, d):
    """Metrics told and recomputed; one is off by more than the tolerance."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("run"))
    own = e.agg((F.sum("value") / F.count("value")).alias("mean"), F.count("*").alias("n"))
    told = e.agg(F.avg("value").alias("mean"), F.count("*").alias("n")).withColumn("mean", F.when(F.col("run") == "click", F.col("mean") * 1.001).otherwise(F.col("mean")))
    return R.recomputed(told, own, "run", ["mean", "n"], 1e-6).select("run", "metric", "ok")


@query("SELECT label AS size, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) >= 1")
def size_guard(spark, d):
    """At least as many rows as wanted, or the query fails."""
    return R.at_least(table(spark, d, "embeddings"), 10, "embeddings").groupBy(F.col("label").alias("size")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, replace(text, 'e', 'E') AS translated FROM conversations")
def translator_hook(spark, d):
    """A callable on batches of texts and languages; this one writes every e as a capital."""
    x = table(spark, d, "conversations").select("conv_id", "turn", F.lit("xx").alias("lang"), "text")
    return R.translate(x, "text", "lang", _capitals).select("conv_id", "turn", "translated")


def _capitals(texts: pd.Series, languages: pd.Series) -> pd.Series:
    return texts.str.replace("e", "E", regex=False)


@query("""WITH p AS (SELECT user_id, event_type, sum(value) AS s, count(value) AS n FROM events GROUP BY 1, 2)
SELECT user_id, round(sum(s) / sum(n), 10) AS mean, sum(n)::BIGINT AS n, string_agg(event_type || '=' || round(s / n, 3)::DECIMAL(18,3), ',' ORDER BY event_type) AS domains FROM p GROUP BY 1""")
def domain_accumulator(spark, d):
    """An update's mean and its means by domain."""
    x = R.domain_accumulator(placed(spark, d, "events"), "user_id", "event_type", "value", PLACE)
    by = F.transform(F.map_entries("by_domain"), lambda e: F.concat(e["key"], F.lit("="), V.rounded(e["value"], 3).cast("decimal(18,3)").cast("string")))
    return x.select("user_id", V.rounded(F.col("mean"), 10).alias("mean"), "n", F.array_join(by, ",").alias("domains"))


@query("SELECT i, j, directed, count(*) AS n FROM (SELECT a.r_regionkey AS i, b.r_regionkey AS j, false AS directed FROM region a JOIN region b ON a.r_regionkey <= b.r_regionkey UNION ALL SELECT a.r_regionkey, b.r_regionkey, true FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey UNION ALL SELECT a.r_regionkey, b.r_regionkey, true FROM region a CROSS JOIN region b) GROUP BY ALL")
def record_pair_forms(spark, d):
    """Pairs with i <= j, directed ones without and with self."""
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("i"))
    forms = [O.record_pairs(r, include_self=True).withColumn("directed", F.lit(False))] + [O.record_pairs(r, directed=True, include_self=s).withColumn("directed", F.lit(True)) for s in (False, True)]
    return forms[0].union(forms[1]).union(forms[2]).groupBy(F.col("left_i").alias("i"), F.col("right_i").alias("j"), "directed").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'What is ' || p_name || '?' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'Answer:' AS prompt, substr('ABCD', (p_partkey % 4)::INT + 1, 1) AS letter FROM part")
def choice_prompts(spark, d):
    """Lettered choices; answers as an index or as a letter."""
    k = F.col("p_partkey")
    letter = F.substring(F.lit("ABCD"), (k % 4 + 1).cast("int"), F.lit(1))
    answer = F.when(k % 2 == 0, (k % 4).cast("string")).otherwise(F.concat(F.lit(" "), F.lower(letter)))
    p = T.choice_prompt(F.concat(F.lit("What is "), "p_name", F.lit("?")), [F.col("p_brand"), F.col("p_type")])
    return table(spark, d, "part").select("p_partkey", p.alias("prompt"), T.choice_letter(answer).alias("letter"))


def _toy_model(f: pd.DataFrame) -> pd.DataFrame:
    """A stand-in model: the first four entries are logits; greedy letter, and the squared norm of the exact gradient."""
    z = np.stack(list(f["embedding"]))[:, :4].astype(float)
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    g = np.eye(4)[f["label"].to_numpy() % 4] - p
    return pd.DataFrame({"vec_id": f["vec_id"], "letter": [("ABCD")[i] for i in z.argmax(1)], "g2": (g * g).sum(1).round(6)})


@query("""WITH z AS (SELECT vec_id, label % 4 + 1 AS y, embedding[1:4]::DOUBLE[] AS z FROM embeddings), p AS (SELECT vec_id, y, z, list_transform(z, lambda x: exp(x) / list_sum(list_transform(z, lambda w: exp(w)))) AS p FROM z)
SELECT vec_id, substr('ABCD', list_position(z, list_max(z))::INT, 1) AS letter, round(1 - 2 * p[y] + list_dot_product(p, p), 6) AS g2 FROM p""")
def model_hook(spark, d):
    """A model on batches of rows, here one that any engine can follow."""
    return R.model_outputs(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), _toy_model, "vec_id bigint, letter string, g2 double")


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(part, -1)::INT AS part, count(*) AS n FROM (SELECT lang, doc_id % 3 AS part FROM documents) GROUP BY CUBE (lang, part)")
def cube_counts(spark, d):
    """All groupings of two keys at once."""
    x = table(spark, d, "documents").select("lang", (F.col("doc_id") % 3).cast("int").alias("part")).cube("lang", "part").agg(F.count("*").alias("n"))
    return x.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("part", F.lit(-1)).alias("part"), "n")
