"""Queries of checks, subsets and rows that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplework.functions import text as T
from ripplework.operators import checks
from ripplework.operators import core as O
from ripplework.plans.registry import query
from ripplework.plans.texts import _PACK, DUCK_PRINT, DUCK_TOKENS, tokens
from ripplework.session import table

#: Four latest events of each user; some rankings are broken on purpose: a rank skipped, a candidate twice, wrong metadata.
_RANKED = """(SELECT user_id, CASE WHEN user_id % 7 = 0 AND r = 2 THEN 5 ELSE r END AS rank, CASE WHEN user_id % 5 = 0 THEN first_value(event_id) OVER (PARTITION BY user_id ORDER BY r) ELSE event_id END AS event_id, CASE WHEN user_id % 11 = 0 THEN 'x' ELSE event_type END AS event_type
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 4)"""


@query(f"SELECT r.user_id, count(*) AS n, list_sort(list(r.rank)) = range(1, count(*) + 1) AS ranks_ok, count(DISTINCT r.event_id) = count(*) AS unique, bool_and(r.event_type = e.event_type) AS meta_ok FROM {_RANKED} r JOIN events e USING (event_id) GROUP BY 1")
def qc_ranking(spark, d):
    """Ranks without gaps, candidates without repeats, metadata as in the table."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    top = O.top_k(e.withColumn("s", F.col("event_id").cast("double")), "user_id", "s", "event_id", 4).drop("s")
    first = top.where("rank = 1").select("user_id", F.col("event_id").alias("latest"))
    broken = lambda n: F.col("user_id") % n == 0
    top = top.join(first, "user_id").select("user_id", F.when(broken(7) & (F.col("rank") == 2), 5).otherwise(F.col("rank")).alias("rank"), F.when(broken(5), F.col("latest")).otherwise(F.col("event_id")).alias("event_id"), F.when(broken(11), "x").otherwise(F.col("event_type")).alias("event_type"))
    return checks.ranking_faults(top, "user_id", "rank", "event_id", e.select("event_id", "event_type"), ["event_type"])


_LOG = "(SELECT user_id AS run, event_id AS step, CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 997 = 0 THEN 'inf'::DOUBLE ELSE value END AS loss FROM events)"


@query(f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM {_LOG} WHERE loss IS NOT NULL) SELECT run, n AS losses, bool_and(isfinite(loss)) AS finite, max(loss) FILTER (i = 0) AS first, max(loss) FILTER (i = n // 2) AS middle, max(loss) FILTER (i = n - 1) AS last, max(loss) FILTER (i = n - 1) < max(loss) FILTER (i = 0) AS decreased FROM l GROUP BY run, n")
def training_logs(spark, d):
    """Finite losses, first, middle and last, and whether the loss fell."""
    loss = F.when(F.col("event_type") == "error", None).when(F.col("event_id") % 997 == 0, float("inf")).otherwise(F.col("value"))
    return checks.log_summary(table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), loss.alias("loss")), "run", "step", "loss")


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5 THEN 'held' ELSE 'train' END AS part FROM documents WHERE len({DUCK_TOKENS}) >= 50")
def held_out_first(spark, d):
    """The first five documents of 50 tokens or more of each source are held out."""
    x = table(spark, d, "documents").select("doc_id", "source", F.size(tokens()).alias("n"))
    return checks.first_valid(x, "source", "doc_id", F.col("n") >= 50, 5).select("doc_id", "part")


@query("""WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || coalesce(source || ':', '') || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT *, CASE WHEN n >= 60 THEN 20 WHEN n <= 20 THEN n // 5 ELSE 20 END AS probe FROM t), u AS (SELECT *, CASE WHEN n >= 60 THEN 40 ELSE n - probe END AS train FROM s)
SELECT source, doc_id, CASE WHEN i <= train THEN 'train' ELSE 'probe' END AS subset FROM u WHERE i <= train + probe""")
def task_subsets(spark, d):
    """40 documents to train on and 20 to probe of each source; smaller sources give what they have."""
    return checks.subsets(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 40, 20, 3, smaller=True)


@query(f"SELECT DISTINCT h FROM (SELECT {DUCK_PRINT} AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SEMI JOIN (SELECT {DUCK_PRINT} AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 0) USING (h)")
def split_overlap(spark, d):
    """Normalised texts that stand among the good and among the bad documents."""
    x = table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("h")).join(table(spark, d, "labels"), "doc_id")
    return checks.overlap(x.where("quality = 1"), x.where("quality = 0"), "h")


@query("SELECT event_type, count(*) FILTER (event_id % 10 <> 0) AS kept, count(*) FILTER (event_id % 10 = 0) AS dropped, sum(CASE WHEN event_id % 10 <> 0 THEN (props ->> '$.k')::BIGINT END)::BIGINT AS total FROM events GROUP BY 1")
def failed_rows(spark, d):
    """rows whose JSON does not parse are dropped, counted and told by type."""
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("props"))
    good, bad = checks.attempted(e, F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"), "k", "no JSON")
    kept = good.groupBy("event_type").agg(F.count("*").alias("kept"), F.sum("k").alias("total"))
    dropped = bad.groupBy("event_type").agg(F.count("__why").alias("dropped"))
    return kept.join(dropped, "event_type", "full").select("event_type", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"), "total")


@query(_PACK + " SELECT lang, (o // 256)::BIGINT AS chunk_index, md5(string_agg(tok, ' ' ORDER BY o)) AS h FROM o WHERE o < (10000 // 256) * 256 GROUP BY 1, 2 HAVING count(*) = 256")
def pack_budget(spark, d):
    """Chunks of 256 tokens up to a budget of 10,000 tokens a language, cut down to whole chunks."""
    x = table(spark, d, "documents").select("doc_id", "lang", tokens().alias("tok"))
    p = O.pack_chunks(x, "doc_id", "tok", 256, ("lang",), "<eos>", budget=10_000)
    return p.select("lang", "chunk_index", F.md5(F.array_join("token_ids", " ")).alias("h"))


def _records(spark, d):
    """Conversations as records of three tasks, with numbers, an annotation and an answer at the end of each message."""
    c = table(spark, d, "conversations").where("text is not null")
    body = F.concat("text", F.lit(" 1,200 and 3.50 <<2+3=5>> #### "), F.col("turn").cast("string"))
    some = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct(F.col("role"), body.alias("content")).alias("m")))), lambda x: x["m"])  # one conversation
    task = F.element_at(F.array(*map(F.lit, checks.CONVERSIONS)), (F.col("conv_id") % 3 + 1).cast("int"))
    return c.groupBy("conv_id").agg(some.alias("messages")).select(F.col("conv_id").cast("string").alias("example_id"), task.alias("task"), "messages")


@query("""SELECT ['English', 'Chinese', 'French'][conv_id % 3 + 1] AS target_language, CASE WHEN conv_id % 3 = 0 THEN 'unchanged' ELSE 'translated' END AS translation_status, count(DISTINCT conv_id) AS records, count(*) AS messages
FROM conversations WHERE text IS NOT NULL AND conv_id % 5 <> 0 GROUP BY 1, 2""")
def converted_records(spark, d):
    """Records by task in its language, those done before passed over."""
    r = _records(spark, d)
    done = r.where(F.col("example_id").cast("bigint") % 5 == 0)
    return checks.converted(r, done).groupBy("target_language", "translation_status").agg(F.count("*").alias("records"), F.sum(F.size("messages")).alias("messages"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1)
SELECT conv_id::VARCHAR AS example_id, CASE WHEN conv_id % 7 = 0 THEN 'missing output' WHEN conv_id % 7 = 1 THEN 'message count changed' WHEN conv_id % 7 = 2 THEN 'role changed' || CASE WHEN conv_id % 3 = 0 THEN ',messages changed' ELSE '' END
  WHEN conv_id % 7 = 3 AND conv_id % 3 = 0 THEN 'messages changed' WHEN conv_id % 7 = 3 AND conv_id % 3 = 1 THEN 'numbers changed' ELSE '' END AS errors FROM c""")
def record_errors(spark, d):
    """Converted records against their sources, with faults of each kind put in."""
    r, n = _records(spark, d), F.col("example_id").cast("bigint") % 7
    made = checks.converted(r).where(n != 0)
    role = F.transform("messages", lambda m: F.struct(F.lit("other").alias("role"), m["content"].alias("content")))
    number = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.regexp_replace(m["content"], "1,200 and", "1,300 and").alias("content")))
    one_less = F.slice("messages", 1, F.size("messages") - 1)
    made = made.withColumn("messages", F.when(n == 1, one_less).when(n == 2, role).when(n == 3, number).otherwise(F.col("messages")))
    return checks.record_errors(r, made).select("example_id", F.array_join("errors", ",").alias("errors"))
