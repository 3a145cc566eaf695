"""Queries on documents, conversations and answers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplework.functions import text as T
from ripplework.operators import core as O
from ripplework.operators import nested
from ripplework.plans.registry import query
from ripplework.session import materialize, table

DUCK_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
DUCK_PRINT = r"sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"
DUCK_TOKENS = "list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')"


def tokens(c="text"):
    """The default tokenizer: runs of a-z of the lower-cased text."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " "), lambda x: x != "")


@query(f"SELECT doc_id, {DUCK_PRINT} AS fp, substr(sha1(source || '::' || doc_id), 1, 16) AS sid, substr(sha256(lang || chr(31) || doc_id), 1, 20) AS eid, ('0x' || substr(sha1(source), 1, 8))::BIGINT AS num FROM documents")
def doc_fingerprint(spark, d):
    """C01-C04."""
    x = table(spark, d, "documents")
    return x.select("doc_id", T.fingerprint(F.col("text")).alias("fp"), T.stable_id(F.col("source"), F.col("doc_id")).alias("sid"), T.example_id(F.col("lang"), F.col("doc_id")).alias("eid"), T.stable_int(F.col("source")).alias("num"))


@query("SELECT source, sha256(string_agg(doc_id || chr(0) || lang || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def stream_digest(spark, d):
    """C05."""
    return table(spark, d, "documents").groupBy("source").agg(T.stream_digest(F.col("doc_id"), F.col("doc_id"), F.col("lang")).alias("digest"))


@query(f"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: {DUCK_STRIP.format('x')}), lambda x: x <> ''), chr(10))) AS h FROM documents")
def clean_lines(spark, d):
    """C06."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_lines(F.col("text"))).alias("h"))


@query("SELECT page_id, coalesce(nullif(trim(CASE WHEN page_id % 3 = 0 THEN ' ' ELSE url END), ''), 'page ' || page_id, '') AS first, CASE WHEN page_id % 3 = 0 THEN 'page ' || page_id ELSE url || chr(10) || chr(10) || 'page ' || page_id END AS whole FROM pages")
def first_text(spark, d):
    """C07, C08."""
    x = table(spark, d, "pages").withColumn("t", F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.col("url"))).withColumn("b", F.concat(F.lit("page "), F.col("page_id")))
    return x.select("page_id", T.first_text(F.col("t"), F.col("b")).alias("first"), T.assemble(F.col("t"), F.col("b")).alias("whole"))


DUCK_ANSWERS = """(SELECT o_orderkey AS k, o_orderpriority AS subject, o_totalprice AS v, substr('ABCD', (o_orderkey % 4 + 1)::INT, 1) AS target, CASE o_orderkey % 19 WHEN 0 THEN '' WHEN 1 THEN '#### ' || substr('ABCD', (o_orderkey % 4 + 1)::INT, 1) WHEN 2 THEN 'Result: B' WHEN 3 THEN 'Answer: C' WHEN 4 THEN '(D).' WHEN 5 THEN 'The answer is option B' WHEN 6 THEN 'Surely A, maybe C' WHEN 7 THEN 'b' WHEN 8 THEN 'b!' WHEN 9 THEN 'Final answer - c' WHEN 10 THEN ' [B] ' WHEN 11 THEN '((d)).' WHEN 12 THEN 'result- [A' WHEN 13 THEN 'the correct answer is d' WHEN 14 THEN repeat('x ', 82) || 'answer: A' WHEN 15 THEN repeat('x ', 41) || 'B' WHEN 16 THEN 'Answer is: e' WHEN 17 THEN 'Choice C or option A' ELSE 'no idea' END AS r, CASE o_orderkey % 5 WHEN 0 THEN 'so #### ' || (o_orderkey % 7) || '.50' WHEN 1 THEN 'it is 1,2' || (o_orderkey % 10) || '0 dollars' WHEN 2 THEN 'none' WHEN 3 THEN '3 then #### -0' ELSE '$5. and 12.' || (o_orderkey % 3) || '00' END AS m FROM orders)"""


def answers(spark, d):
    """Derived responses that show every answer form."""
    k = F.col("o_orderkey")
    pick = lambda n, *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    letter = pick(4, "A", "B", "C", "D")
    more = ("b!", "Final answer - c", " [B] ", "((d)).", "result- [A", "the correct answer is d", "x " * 82 + "answer: A", "x " * 41 + "B", "Answer is: e", "Choice C or option A")
    r = pick(19, "", F.concat(F.lit("#### "), letter), "Result: B", "Answer: C", "(D).", "The answer is option B", "Surely A, maybe C", "b", *more, "no idea")
    m = pick(5, F.concat(F.lit("so #### "), k % 7, F.lit(".50")), F.concat(F.lit("it is 1,2"), k % 10, F.lit("0 dollars")), "none", "3 then #### -0", F.concat(F.lit("$5. and 12."), k % 3, F.lit("00")))
    return table(spark, d, "orders").select(k.alias("k"), F.col("o_orderpriority").alias("subject"), F.col("o_totalprice").alias("v"), letter.alias("target"), r.alias("r"), m.alias("m"))


DUCK_FORMAT = r"CASE WHEN trim(r) = '' THEN 'empty' WHEN contains(r, '###') THEN 'gsm8k_hash' WHEN regexp_matches(trim(r), '(?i)^\s*result\s*[:\-]') THEN 'result_label' WHEN regexp_matches(trim(r), '(?i)^\s*(?:final\s+answer|answer)\s*(?:is\s*)?[:\-]') THEN 'answer_label' WHEN regexp_matches(trim(r), '(?i)^[\s\[\(]*([ABCD])[\s\]\)\.,:;!?]*$') THEN 'letter_only' WHEN regexp_matches(trim(r)[1:160], '(?i)\b(?:the\s+)?(?:correct\s+)?answer\s+is\s+([ABCD])\b') THEN 'verbal_answer' ELSE 'other' END"
DUCK_LAST = r"upper(coalesce(regexp_extract_all(r, '(?i)####\s*([ABCD])\b', 1)[-1], regexp_extract_all(r, '(?i)\b([ABCD])\b', 1)[-1], ''))"
DUCK_FIRST = r"upper(coalesce(nullif(regexp_extract(trim(r), '(?i)^[\s\[\(]*([ABCD])[\s\]\)\.,:;!?]*$', 1), ''), nullif(regexp_extract(trim(r)[1:160], '(?i)\b(?:final\s+answer|answer|result|option|choice)\s*(?:is\s*)?[:\-]?\s*[\[\(]?\s*([ABCD])\b', 1), ''), nullif(regexp_extract(trim(r)[1:160], '(?i)\b(?:the\s+)?(?:correct\s+)?answer\s+is\s+([ABCD])\b', 1), ''), nullif(regexp_extract(trim(r)[1:80], '(?i)\b([ABCD])\b', 1), ''), ''))"


@query(f"SELECT k, {DUCK_LAST} AS last, {DUCK_FIRST} AS first, {DUCK_FORMAT} AS fmt FROM {DUCK_ANSWERS}")
def extract_choice(spark, d):
    """C09-C11."""
    c = F.col("r")
    return answers(spark, d).select("k", T.last_choice(c).alias("last"), T.first_choice(c).alias("first"), T.answer_format(c).alias("fmt"))


_NUM = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
_CANON = "coalesce(regexp_replace(regexp_replace(CASE WHEN contains(({0})::VARCHAR, '.') THEN regexp_replace(({0})::VARCHAR, '\\.?0+$', '') ELSE ({0})::VARCHAR END, '^-0$', '0'), '^$', '0'), '')"


@query(f"SELECT k, {_CANON.format(f'''try_cast(replace(regexp_extract_all(m, '####\\s*({_NUM})', 1)[-1], ',', '') AS DECIMAL(38,10))''')} AS strict, {_CANON.format(f'''try_cast(replace(regexp_extract_all(m, '({_NUM})', 1)[-1], ',', '') AS DECIMAL(38,10))''')} AS relaxed, coalesce(nullif(replace(regexp_extract(m, '#### (\\-?[0-9\\.,]+)', 1), ',', ''), ''), 'N/A') AS solution FROM {DUCK_ANSWERS}")
def numeric_answer(spark, d):
    """C13-C15, C17."""
    c = F.col("m")
    return answers(spark, d).select("k", T.numeric_answer(c, True).alias("strict"), T.numeric_answer(c, False).alias("relaxed"), T.solution(c).alias("solution"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), p AS (SELECT k, c,
  CASE k % 5 WHEN 0 THEN '$' || (1000 + c % 3) || '.' WHEN 1 THEN (c % 4) || '/' || (c % 3) WHEN 2 THEN (c % 5) || '%' WHEN 3 THEN 'Paris ' ELSE (c % 2) || ',000.50' END AS a,
  CASE k % 5 WHEN 0 THEN '1,00' || (k % 3) || '.0' WHEN 1 THEN (k % 4) || '/2' WHEN 2 THEN '' || (k % 3) ELSE CASE WHEN c % 2 = 0 THEN ' pARIS' ELSE '1000.5' END END AS b FROM o),
v AS (SELECT k, a, b, list_transform([a, b], lambda x: try_cast(regexp_replace(regexp_replace(trim(split_part(x, '/', 1)), '[,$%]', '', 'g'), '\\.+$', '') AS DOUBLE)) AS n, list_transform([a, b], lambda x: CASE WHEN contains(x, '/') THEN try_cast(split_part(x, '/', 2) AS DOUBLE) ELSE 1.0 END) AS d FROM p)
SELECT k, coalesce(CASE WHEN d[1] <> 0 AND d[2] <> 0 THEN n[1] * d[2] = n[2] * d[1] END, lower(trim(a)) = lower(trim(b)), false) AS same FROM v""")
def answers_match(spark, d):
    """Amounts, fractions (over zero too), percentages and words, made from keys so that some agree."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    a = F.when(k % 5 == 0, cat("$", 1000 + c % 3, ".")).when(k % 5 == 1, cat(c % 4, "/", c % 3)).when(k % 5 == 2, cat(c % 5, "%")).when(k % 5 == 3, "Paris ").otherwise(cat(c % 2, ",000.50"))
    b = F.when(k % 5 == 0, cat("1,00", k % 3, ".0")).when(k % 5 == 1, cat(k % 4, "/2")).when(k % 5 == 2, cat(k % 3)).when(c % 2 == 0, " pARIS").otherwise("1000.5")
    return table(spark, d, "orders").select(k.alias("k"), T.same_answer(a, b).alias("same"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE trim(text) END AS t FROM (SELECT conv_id, turn, 'Yes ' || (turn % 7) AS text FROM conversations)")
def eos_stripped(spark, d):
    """C12."""
    x = table(spark, d, "conversations").withColumn("t", F.concat(F.lit("Yes "), F.col("turn") % 7, F.when(F.col("turn") % 2 == 0, " </s> <|im_end|>\n").otherwise("")))
    return x.select("conv_id", "turn", T.strip_eos(F.col("t")).alias("t"))


@query("SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(source || '/' || lang || ' ', '[^0-9A-Za-z_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS slug, CASE doc_id % 4 WHEN 0 THEN 10000 WHEN 1 THEN 5500000 WHEN 2 THEN 2000000000 ELSE doc_id END::BIGINT AS n, source AS nm, lang AS vl, 2::BIGINT AS parts FROM documents")
def slugs_and_specs(spark, d):
    """C24-C27."""
    x = table(spark, d, "documents")
    n = F.when(F.col("doc_id") % 4 == 0, "10K").when(F.col("doc_id") % 4 == 1, "5.5M").when(F.col("doc_id") % 4 == 2, "2b").otherwise(F.col("doc_id").cast("string"))
    nv = T.name_value(F.concat("source", F.lit("="), "lang"))
    return x.select("doc_id", T.slug(F.concat("source", F.lit("/"), "lang", F.lit(" "))).alias("slug"), T.token_count(n).alias("n"), nv["name"].alias("nm"), nv["value"].alias("vl"), F.size(T.comma_list(F.concat("source", F.lit(", ,"), "lang"))).cast("bigint").alias("parts"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents), k AS (SELECT *, greatest(1, least(len(w) // 3, len(w) - 16)) AS k FROM w)
SELECT doc_id, md5(array_to_string(w[1:k], ' ')) AS p, md5(array_to_string(w[k+1:], ' ')) AS t FROM k""")
def split_supervision(spark, d):
    """C28."""
    s = T.split_supervision(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(s["prompt"]).alias("p"), F.md5(s["target"]).alias("t"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {DUCK_PRINT} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup(spark, d):
    """W13, R05's batch form."""
    x = table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("h"))
    return O.first_wins(x, ["h"], "doc_id").select("doc_id")


@query(f"SELECT doc_id, {DUCK_PRINT} IN (SELECT {DUCK_PRINT} FROM benchmark) AS contaminated FROM documents")
def contamination_exact(spark, d):
    """J12, T05."""
    return O.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "contaminated")


_NESTED = "(SELECT conv_id, turn, unnest(list_concat([role], string_split(text, chr(10)), [text, role])) AS leaf FROM conversations)"


@query(f"SELECT conv_id, turn, leaf FROM {_NESTED} WHERE leaf IS NOT NULL")
def string_leaves(spark, d):
    """The strings of records nested in objects and arrays, with escapes."""
    part = F.struct(F.split("text", "\n").alias("lines"), F.array(F.struct(F.col("text"), F.col("turn"), F.array(F.array("role")).alias("by"))).alias("whole"))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.col("conv_id").alias("number"), part.alias("content"))).alias("body"))
    return nested.string_leaves(c, F.col("body"), "conv_id", "turn").select("conv_id", "turn", "leaf")


@query(f"SELECT doc_id, {DUCK_PRINT} IN (SELECT {DUCK_PRINT} FROM (SELECT text FROM benchmark UNION ALL SELECT leaf FROM {_NESTED})) AS contaminated FROM documents")
def contamination_leaves(spark, d):
    """Documents whose normalised text is any string of the downstream records, however deep."""
    row = F.to_json(F.struct(F.array(F.struct(F.struct("text").alias("question"))).alias("data")))
    items = nested.string_leaves(table(spark, d, "benchmark").select(row.alias("body")), F.col("body"))
    leaves = items.select(F.col("leaf").alias("text")).union(string_leaves(spark, d).select("leaf"))
    return O.contamination(table(spark, d, "documents"), leaves).select("doc_id", "contaminated")


@query("SELECT lang, count(*) AS docs, sum(len(t))::BIGINT AS tokens, round(avg(len(t)), 6) AS mean_tokens, round(median(len(t)), 6) AS median_tokens, round(sum(len(t)) / (sum(sum(len(t))) OVER ()), 6) AS share, count(*) FILTER (len(t) < 50) AS short FROM (SELECT lang, " + DUCK_TOKENS + " AS t FROM documents) GROUP BY lang")
def domain_stats(spark, d):
    """A14, F05."""
    x = table(spark, d, "documents").select("lang", F.size(tokens()).alias("n"))
    g = x.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").cast("bigint").alias("tokens"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.round(F.percentile("n", F.lit(0.5)), 6).alias("median_tokens"), F.count_if(F.col("n") < 50).alias("short"))
    return g.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(W.partitionBy(F.lit(1))), 6))


@query("SELECT source, round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n)::DOUBLE AS max, list_sort(list(n))[(floor(0.95 * (count(*) - 1)) + 1)::INT]::BIGINT AS p95_floor FROM (SELECT source, n_chars AS n FROM documents) GROUP BY source")
def length_percentiles(spark, d):
    """A15, A16, X10."""
    n = F.col("n_chars").cast("double")
    cols = [F.round(c, 6).alias(a) for c, a in zip(O.distribution(n), ("mean", "median", "p90", "p95", "p99", "max"), strict=True)]
    x = table(spark, d, "documents").select("source", "n_chars")
    return x.groupBy("source").agg(*cols).join(O.floor_percentile(x, "source", "n_chars", 0.95, "p95_floor"), "source")


_PACK = f"WITH t AS (SELECT doc_id, lang, unnest(list_append({DUCK_TOKENS}, '<eos>')) AS tok, generate_subscripts(list_append({DUCK_TOKENS}, '<eos>'), 1) AS p FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, p) - 1 AS o FROM t)"


@query(_PACK + " SELECT lang, (o // 256)::BIGINT AS chunk_index, md5(string_agg(tok, ' ' ORDER BY o)) AS h, 256::BIGINT AS n FROM o GROUP BY 1, 2 HAVING count(*) = 256")
def pack_chunks(spark, d):
    """W11, T01, T03."""
    x = table(spark, d, "documents").select("doc_id", "lang", tokens().alias("tok"))
    p = O.pack_chunks(x, "doc_id", "tok", 256, ("lang",), "<eos>")
    return p.select("lang", "chunk_index", F.md5(F.array_join("token_ids", " ")).alias("h"), F.size("token_ids").cast("bigint").alias("n"))


@query(_PACK + " SELECT lang, (o // 256)::BIGINT AS chunk_index, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS docs FROM o GROUP BY 1, 2")
def chunk_doc_ids(spark, d):
    """T02."""
    x = table(spark, d, "documents").select("doc_id", "lang", (F.size(tokens()) + 1).cast("bigint").alias("n"))
    x = O.prefix_sum(x, "doc_id", "n", ("lang",))
    c = x.withColumn("chunk_index", F.explode(F.sequence(F.floor(F.col("before") / 256), F.floor((F.col("before") + F.col("n") - 1) / 256))))
    return c.groupBy("lang", "chunk_index").agg(F.array_join(F.transform(F.array_sort(F.collect_set("doc_id")), lambda v: v.cast("string")), ",").alias("docs"))


@query(f"SELECT doc_id, (b // 20000)::BIGINT AS shard, b < 5000 AS probe FROM (SELECT doc_id, sum(len({DUCK_TOKENS})) OVER (ORDER BY doc_id) - len({DUCK_TOKENS}) AS b FROM documents)")
def shard_assignment(spark, d):
    """The first documents up to a token budget, and blocks of tokens after them."""
    x = table(spark, d, "documents").select("doc_id", F.size(tokens()).cast("bigint").alias("n"))
    x = O.prefix_sum(x, "doc_id", "n")
    return x.select("doc_id", F.floor(F.col("before") / 20000).alias("shard"), (F.col("before") < 5000).alias("probe"))


_COUNTS = f"WITH c AS (SELECT lang, tok, count(*) AS n FROM (SELECT lang, unnest({DUCK_TOKENS}) AS tok FROM documents) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tok) AS rank FROM c)"


def token_counts_of(spark, d):
    return table(spark, d, "documents").select("lang", F.explode(tokens()).alias("tok")).groupBy("lang", "tok").agg(F.count("*").alias("n"))


def top_sets(spark, d, k=100):
    return token_counts_of(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "tok"))).where(F.col("rank") <= k)


@query(_COUNTS + " SELECT lang, tok, n, rank FROM r WHERE rank <= 100")
def top_tokens(spark, d):
    """A13, W01, O05."""
    return top_sets(spark, d)


@query(_COUNTS + ", s AS (SELECT * FROM r WHERE rank <= 100), l AS (SELECT DISTINCT lang FROM s) SELECT a.lang AS a, b.lang AS b, count(x.tok) AS inter, round(count(x.tok) / (200.0 - count(x.tok)), 6) AS jaccard FROM l a JOIN l b ON a.lang < b.lang LEFT JOIN (SELECT p.lang AS la, q.lang AS lb, p.tok FROM s p JOIN s q USING (tok)) x ON x.la = a.lang AND x.lb = b.lang GROUP BY 1, 2")
def jaccard_tasks(spark, d):
    """U02, J10."""
    sets = top_sets(spark, d).groupBy("lang").agg(F.collect_set("tok").alias("s"))
    p = O.record_pairs(sets, "lang")
    inter = F.size(F.array_intersect("left_s", "right_s"))
    return p.select(F.col("left_lang").alias("a"), F.col("right_lang").alias("b"), inter.cast("bigint").alias("inter"), F.round(F.coalesce(inter / F.nullif(F.size(F.array_union("left_s", "right_s")), F.lit(0)), F.lit(0.0)), 6).alias("jaccard"))


@query(_COUNTS + " SELECT tok FROM r WHERE rank <= 100 GROUP BY tok HAVING count(DISTINCT lang) = 4")
def shared_tokens(spark, d):
    """U01."""
    return top_sets(spark, d).groupBy("tok").agg(F.count_distinct("lang").alias("k")).where("k = 4").select("tok")


@query(_COUNTS + " SELECT c.lang, c.tok, round(c.n / (1.0 + coalesce(max(o.n), 0)), 6) AS specificity FROM r c LEFT JOIN c o ON o.tok = c.tok AND o.lang <> c.lang WHERE c.rank <= 100 GROUP BY c.lang, c.tok, c.n")
def token_specificity(spark, d):
    """The largest other count from the two largest."""
    c = token_counts_of(spark, d)
    two = c.groupBy("tok").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "lang")), asc=False), 1, 2).alias("t"))  # a row for each task
    other = F.coalesce(F.when(F.col("t")[0]["lang"] != F.col("lang"), F.col("t")[0]["n"]).otherwise(F.get("t", F.lit(1))["n"]), F.lit(0))
    return top_sets(spark, d).join(two, "tok").select("lang", "tok", F.round(F.col("n") / (F.lit(1.0) + other), 6).alias("specificity"))


_RUN = f"(SELECT k, subject, {DUCK_FORMAT} AS fmt, {DUCK_FIRST} = target AS relaxed, trim(r) = target AS strict, {DUCK_FORMAT} = 'letter_only' AS canonical FROM {DUCK_ANSWERS})"


def run_of(spark, d):
    a = answers(spark, d).withColumn("fmt", T.answer_format(F.col("r")))
    return a.select("k", "subject", "fmt", (T.first_choice(F.col("r")) == F.col("target")).alias("relaxed"), (T.strip(F.col("r")) == F.col("target")).alias("strict"), (F.col("fmt") == "letter_only").alias("canonical"))


@query(f"SELECT count(*) AS n, round(avg(relaxed::INT), 6) AS relaxed, round(avg(strict::INT), 6) AS strict, round(avg(canonical::INT), 6) AS canonical, count(*) FILTER (relaxed AND NOT canonical) AS correct_noncanonical, round(avg((relaxed AND NOT strict)::INT), 6) AS lost FROM {_RUN}")
def run_summary(spark, d):
    """A01, A05."""
    r = F.col
    return run_of(spark, d).agg(F.count("*").alias("n"), *[F.round(O.rate(r(c)), 6).alias(c) for c in ("relaxed", "strict", "canonical")], F.count_if(r("relaxed") & ~r("canonical")).alias("correct_noncanonical"), F.round(O.rate(r("relaxed") & ~r("strict")), 6).alias("lost"))


_TRIAL = f"(SELECT k + 1 AS k, fmt AS fmt2, canonical AS canonical2, relaxed AS relaxed2 FROM {_RUN})"


@query(f"SELECT fmt || ' -> ' || fmt2 AS change, count(*) AS n, count(*) FILTER (canonical AND NOT canonical2) AS lost_canonical, count(*) FILTER (relaxed AND NOT relaxed2) AS lost_answer FROM {_RUN} JOIN {_TRIAL} USING (k) GROUP BY 1")
def format_transitions(spark, d):
    """A02, J01."""
    a = materialize(run_of(spark, d), "run")  # read four times
    b = a.select((F.col("k") + 1).alias("k"), F.col("fmt").alias("fmt2"), F.col("canonical").alias("canonical2"), F.col("relaxed").alias("relaxed2"))
    both = a.join(b.select("k"), "k", "left_semi")
    j = O.join_equal_keys(both, b.join(a.select("k"), "k", "left_semi"), "k")
    return j.groupBy(F.concat_ws(" -> ", "fmt", "fmt2").alias("change")).agg(F.count("*").alias("n"), F.count_if(F.col("canonical") & ~F.col("canonical2")).alias("lost_canonical"), F.count_if(F.col("relaxed") & ~F.col("relaxed2")).alias("lost_answer"))


@query(f"SELECT coalesce(subject, 'all') AS subject, count(*) AS n, round(avg(relaxed::INT), 6) AS exact, round(avg((fmt = 'gsm8k_hash')::INT), 6) AS hash FROM {_RUN} GROUP BY GROUPING SETS ((subject), ())")
def behavior_by_subject(spark, d):
    """A03, A04."""
    r = run_of(spark, d).rollup("subject").agg(F.count("*").alias("n"), F.round(O.rate(F.col("relaxed")), 6).alias("exact"), F.round(O.rate(F.col("fmt") == "gsm8k_hash"), 6).alias("hash"))
    return r.withColumn("subject", F.coalesce("subject", F.lit("all")))


@query(f"SELECT r.subject, accuracy, k, row_number() OVER (PARTITION BY r.subject ORDER BY k) - 1 AS place FROM {_RUN} r JOIN (SELECT subject, round(avg(relaxed::INT), 6) AS accuracy FROM {_RUN} GROUP BY 1) a ON a.subject = r.subject WHERE NOT relaxed")
def wrong_indices(spark, d):
    """The ordered list of wrong indices is rows with their places, so no task holds a subject."""
    x = run_of(spark, d).select("subject", "k", "relaxed")
    wrong = O.prefix_sum(x.where("not relaxed").withColumn("one", F.lit(1).cast("bigint")), "k", "one", ("subject",), out="place")
    return wrong.join(x.groupBy("subject").agg(F.round(O.rate(F.col("relaxed")), 6).alias("accuracy")), "subject").select("subject", "accuracy", "k", "place")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def semi_wrong(spark, d):
    """F16."""
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 0"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_resume(spark, d):
    """K10, U03."""
    return O.resume(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id, coalesce(l.quality, -1)::INT AS quality, l.quality IS NULL AS missing FROM documents LEFT JOIN (SELECT doc_id, min_by(quality, toxic) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def precedence_merge(spark, d):
    """J13, T11."""
    first = O.first_wins(table(spark, d, "labels"), ["doc_id"], "toxic").select("doc_id", "quality")
    return table(spark, d, "documents").join(first, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("quality").isNull().alias("missing"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3")
def group_sample(spark, d):
    """M01."""
    return O.sample_per_group(table(spark, d, "documents"), "source", "doc_id", 3, 7).select("doc_id", "source")


@query("SELECT doc_id FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 40")
def hash_shuffle_take(spark, d):
    """M04, M05, O03."""
    return O.shuffle_take(table(spark, d, "documents"), "doc_id", 40, 11).select("doc_id")


@query("SELECT conv_id, count(*) AS messages, max_by(role, turn) AS last_role, md5(string_agg(lower(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS h, count(*) >= 2 AND max_by(role, turn) = 'assistant' AS valid FROM conversations GROUP BY conv_id")
def conv_messages(spark, d):
    """P14, C30, F08."""
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    t = F.array_join(F.transform("m", lambda r: F.concat(F.lower(r["role"]), F.lit(": "), r["text"])), "\n\n")
    last = F.element_at("m", -1)["role"]
    return x.select("conv_id", F.size("m").cast("bigint").alias("messages"), last.alias("last_role"), F.md5(t).alias("h"), ((F.size("m") >= 2) & (last == "assistant")).alias("valid"))


@query("WITH l AS (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT c.conv_id, md5(coalesce(string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) || chr(10) ORDER BY turn) FILTER (turn < t), '')) AS prompt, md5(max(text) FILTER (turn = t)) AS completion FROM conversations c JOIN l USING (conv_id) GROUP BY c.conv_id")
def prompt_completion(spark, d):
    """C29."""
    c = table(spark, d, "conversations")
    last = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("t"))
    x = c.join(last, "conv_id").groupBy("conv_id", "t").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    before = F.filter("m", lambda r: r["turn"] < F.col("t"))
    prompt = F.array_join(F.transform(before, lambda r: F.concat(F.initcap(r["role"]), F.lit(": "), r["text"])), "\n\n")
    done = F.element_at(F.filter("m", lambda r: r["turn"] == F.col("t")), 1)["text"]
    return x.select("conv_id", F.md5(prompt).alias("prompt"), F.md5(done).alias("completion"))


@query("SELECT conv_id, CASE WHEN r <= 20 THEN 'probe' ELSE 'train' END AS part FROM (SELECT conv_id, row_number() OVER (ORDER BY md5('3:' || conv_id), conv_id) AS r FROM (SELECT DISTINCT conv_id FROM conversations))")
def subset_split(spark, d):
    """T06."""
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    probe = O.shuffle_take(ids, "conv_id", 20, 3).withColumn("part", F.lit("probe"))
    return ids.join(probe, "conv_id", "left").select("conv_id", F.coalesce("part", F.lit("train")).alias("part"))


@query("SELECT doc_id, row_number() OVER (ORDER BY r, source) - 1 AS pos FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)")
def round_robin(spark, d):
    """The place is (round - 1) x sources + place among those still in, counted without a global window."""
    x = table(spark, d, "documents").select("doc_id", "source", F.lit(1).cast("bigint").alias("one"))
    x = O.prefix_sum(x, "doc_id", "one", ("source",), out="r").drop("one")
    per = x.groupBy("r").agg(F.count("*").alias("n"))
    per = O.prefix_sum(per, "r", "n")
    inside = F.row_number().over(W.partitionBy("r").orderBy("source")) - 1
    return x.withColumn("i", inside).join(per.select("r", "before"), "r").select("doc_id", (F.col("before") + F.col("i")).alias("pos"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, d):
    """C20."""
    return table(spark, d, "events").select("event_id", T.json_object(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "k int")["k"].alias("k"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place, round((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 0.5) / count(*) OVER (PARTITION BY lang), 9) AS key FROM documents")
def shard_interleave(spark, d):
    """A deterministic proportional order; sorting by key spreads every domain evenly over the run."""
    x = table(spark, d, "documents").select("doc_id", "lang", F.lit(1).cast("bigint").alias("one"))
    n = x.groupBy("lang").agg(F.count("*").alias("n"))
    x = O.prefix_sum(x, "doc_id", "one", ("lang",)).join(n, "lang")
    return x.select("doc_id", (F.col("before") + 1).alias("place"), F.round((F.col("before") + F.lit(0.5)) / F.col("n"), 9).alias("key"))


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'role,numbers' WHEN turn % 5 = 3 THEN 'numbers' ELSE '' END AS errors FROM conversations")
def translated_records(spark, d):
    """A passthrough translation and one with faults; roles and numbers must survive."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lower("role").alias("role"), F.concat(F.lit("Take 1,200 and 3.50, turn "), "turn").alias("text"))
    t = c.withColumn("new_text", F.when(F.col("turn") % 5 >= 3, F.regexp_replace("text", "3.50", "4")).otherwise(F.col("text"))).withColumn("new_role", F.when(F.col("turn") % 5 == 4, "other").otherwise(F.col("role")))
    bad = F.array(F.when(F.col("role") != F.col("new_role"), "role"), F.when(T.numbers(F.col("text")) != T.numbers(F.col("new_text")), "numbers"))
    return t.select("conv_id", "turn", F.concat_ws(",", F.array_compact(bad)).alias("errors"))
