"""Queries on sources, sinks and streams: what is written is read again, and what must be refused is."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from ripplework.functions import text as T
from ripplework.operators import tiles
from ripplework.plans.registry import query
from ripplework.plans.texts import DUCK_PRINT, DUCK_TOKENS, tokens
from ripplework.plans.vectors import _E
from ripplework.session import shared_dir, table
from ripplework.sources import history, io
from ripplework.streaming import streams


def _path(spark, name):
    return f"{shared_dir(spark)}/ripplework/{name}-{uuid.uuid4().hex}"


def _refused(make) -> bool:
    """Whether making a frame, or running it, fails."""
    try:
        make().write.format("noop").mode("overwrite").save()
    except (PySparkException, ValueError):
        return True
    return False


def _texts(df, path, value, **options):
    """One text file of one value a row."""
    df.select(F.col(value) if isinstance(value, str) else value).coalesce(1).write.options(**options).text(path)


@query("SELECT r_regionkey::BIGINT AS region, count(*) AS nations, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def json_document(spark, d):
    """One JSON document over many lines, with a list of records, and a map of datasets."""
    path = _path(spark, "json")
    rows = table(spark, d, "nation").select(F.struct(F.col("n_nationkey").cast("bigint").alias("index"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region")).alias("r"))
    doc = F.to_json(F.struct(F.array_sort(F.collect_list("r")).alias("records")), {"pretty": "true"})
    _texts(rows.agg(doc.alias("value")), path, "value")
    back = io.read_json(spark, path, "records array<struct<index: bigint, name: string, region: bigint>>").select(F.inline("records"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("index", "name"))), lambda r: r["name"])
    return back.groupBy("region").agg(F.count("*").alias("nations"), F.array_join(names, ",").alias("names"))


@query("SELECT conv_id, count(*) FILTER (turn % 3 <> 1) AS n, true AS refused FROM conversations GROUP BY 1 HAVING count(*) FILTER (turn % 3 <> 1) > 0")
def strict_jsonl(spark, d):
    """Lines that are no JSON object, or none at all; read strictly they fail the read, else they are left out."""
    c = table(spark, d, "conversations")
    good = F.to_json(F.struct("conv_id", "turn"))
    path = _path(spark, "lines")
    _texts(c, path, F.when(c["turn"] % 3 == 1, F.when(c["conv_id"] % 2 == 0, '{"conv_id": 1,').otherwise("[1, 2]")).otherwise(good).alias("value"))
    schema = "conv_id bigint, turn bigint"
    refused = _refused(lambda: io.read_jsonl(spark, path, schema, strict=True))
    back = io.read_jsonl(spark, path, schema).where("conv_id is not null and turn is not null")
    return back.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query("""WITH f AS (SELECT sha256(string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' || chr(10), '' ORDER BY n_nationkey)) AS h, sum(length('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') + 1)::BIGINT AS b FROM nation)
SELECT h AS sha256, b AS bytes, 0::BIGINT AS changed, 1::BIGINT AS lost, true AS refused FROM f""")
def manifest_guard(spark, d):
    """Size and digest of a written file; a manifest equals itself read again; a file that is gone is told; an output that is there is refused."""
    path = _path(spark, "manifest")
    n = table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey")
    io.write_jsonl(n, path)
    refused = False
    try:
        io.write_jsonl(n, path)
    except AnalysisException:
        refused = True
    m = io.manifest(spark, path)
    m = m.where("name like 'part-%'")
    changed, lost = (io.manifest_diff(m, x).agg(F.count("*").alias(name)) for x, name in ((io.manifest(spark, path).where("name like 'part-%'"), "changed"), (m.limit(0), "lost")))
    return m.select("sha256", "bytes").crossJoin(F.broadcast(changed)).crossJoin(F.broadcast(lost)).withColumn("refused", F.lit(refused))  # one row each


@query("SELECT coalesce(lang, 'none') AS lang, count(*) AS n, min(doc_id) AS least FROM documents GROUP BY 1")
def split_folders(spark, d):
    """A dataset folder by split; a split reads its folder alone. The splits are those of the data."""
    path = _path(spark, "splits")
    table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("split")).write.partitionBy("split").parquet(path)
    names = [r[0] for r in spark.read.parquet(path).select("split").distinct().collect()]  # a row for each folder
    parts = [io.read_split(spark, path, s).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).select(F.lit(s).alias("lang"), "n", "least") for s in names]
    return reduce(lambda a, b: a.union(b), parts)


@query("SELECT 'csv' AS source, count(*) AS n, round(avg(value), 6) AS mean, true AS all_failed FROM events")
def source_fallback(spark, d):
    """A Parquet cache that is not there, then a CSV that is; if none is, all errors are told."""
    path = _path(spark, "cache")
    table(spark, d, "events").select("event_id", "value").write.option("header", True).csv(f"{path}/history.csv")
    csv = lambda p: lambda: io.read_delimited(spark, p, ["event_id", "value"], numeric=("value",))
    got, name = io.first_available([("parquet", lambda: spark.read.parquet(f"{path}/history.parquet")), ("csv", csv(f"{path}/history.csv"))])
    try:
        io.first_available([("parquet", lambda: spark.read.parquet(f"{path}/none")), ("csv", csv(f"{path}/nowhere"))])
        failed = False
    except FileNotFoundError as e:
        failed = "parquet" in str(e) and "csv" in str(e)
    return got.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).withColumns({"source": F.lit(name), "all_failed": F.lit(failed)})


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def first_rows(spark, d):
    """The first rows of a source by its own index."""
    return io.first_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 25)


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 250")
def streamed_first_rows(spark, d):
    """The first rows of a stream of files, which ends once they stand."""
    path, e = _path(spark, "files"), table(spark, d, "events").select("event_id")
    cuts = e.agg(F.percentile_approx("event_id", F.array(*[F.lit(q / 6) for q in range(1, 6)]))).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = e if low is None else e.where(F.col("event_id") > low)
        part = part if high is None else part.where(F.col("event_id") <= high)
        part.coalesce(1).sortWithinPartitions("event_id").write.mode("append").parquet(path)
    got, files = io.first_rows_streamed(spark, path, "event_id bigint", 250)
    if files > max(1, len(cuts)) and len(cuts) > 1 and e.count() > 1000:
        raise RuntimeError("the stream did not stop early")
    return got


@query("SELECT 'chat' AS name, conv_id || ':' || turn AS key FROM (SELECT conv_id, turn FROM conversations ORDER BY md5('3:' || conv_id || ':' || turn), conv_id || ':' || turn LIMIT 12) UNION ALL SELECT 'docs', doc_id::VARCHAR FROM documents")
def dataset_registry(spark, d):
    """Datasets by name and alias, one of them limited in the order of a seeded hash."""
    r = io.Registry()
    r.add(lambda: table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key")), "chat", "conversations", "org/chat")
    r.add(lambda: table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key")), "docs")
    chat = r.load(" Org/Chat", "key", 12, 3).select(F.lit("chat").alias("name"), "key")
    return chat.union(r.load("docs").select(F.lit("docs").alias("name"), "key"))


@query("SELECT source AS domain, CASE WHEN count(*) FILTER (lang = 'fr') > 0 THEN max(n_chars) ELSE min(n_chars) END AS min_tokens, 'text' AS col, round(count(*) / (SELECT count(*) FROM documents WHERE source IS NOT NULL), 6) AS share FROM documents WHERE source IS NOT NULL GROUP BY 1")
def layered_specs(spark, d):
    """A spec for each source from the table, with an override for sources that have French, merged key by key."""
    x = table(spark, d, "documents").where("source is not null")
    share = F.round(F.count("*") / F.lit(x.count()), 6)
    told = x.groupBy("source").agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), share.alias("share"), F.count_if(F.col("lang") == "fr").alias("french"))
    base, over = _path(spark, "specs"), _path(spark, "override")
    line = lambda *c: F.to_json(F.struct(F.col("source").alias("domain"), F.struct(*c).alias("spec"))).alias("value")
    told.select(line(F.col("low").alias("min_tokens"), F.lit("text").alias("col"), "share")).write.text(base)
    told.where("french > 0").select(line(F.col("high").alias("min_tokens"))).write.text(over)
    specs = [{v["domain"]: v["spec"] for v in (json.loads(r[0]) for r in spark.read.text(p).collect())} for p in (base, over)]  # a row for each source
    return spark.createDataFrame([(k, v["min_tokens"], v["col"], v["share"]) for k, v in io.layered(*specs).items()], "domain string, min_tokens bigint, col string, share double")


@query("SELECT doc_id FROM documents WHERE n_chars >= 100 AND lang IN ('en', 'de') AND source IS NOT NULL")
def yaml_config(spark, d):
    """A filter that a YAML file names, with nested keys, lists and scalars."""
    path = _path(spark, "yaml")
    text = "# filter\nname: 'the \"filter\"'\ndocs:\n  min_chars: 100\n  share: 0.5\n  langs:\n    - en\n    - de\n  empty:\nkeep: true\ninline: [1, two]\n"
    spark.range(1).select(F.lit(text).alias("value")).write.text(path)
    c = io.read_yaml(spark, path)
    if c["name"] != 'the "filter"' or c["inline"] != [1, "two"] or c["keep"] is not True or c["docs"]["share"] != 0.5:
        raise ValueError(c)
    return table(spark, d, "documents").where((F.col("n_chars") >= c["docs"]["min_chars"]) & F.col("lang").isin(c["docs"]["langs"]) & F.col("source").isNotNull()).select("doc_id")


@query("SELECT lang, source, 1::BIGINT AS files FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2")
def discovered_files(spark, d):
    """Files of a tree, with what their folders say of them."""
    path = _path(spark, "tree")
    x = table(spark, d, "documents").select("doc_id", F.col("lang").alias("l"), F.col("source").alias("s")).where("l is not null and s is not null")
    x.repartition("l", "s").write.partitionBy("l", "s").parquet(path)
    f = io.discover(spark, path, r"/l=([^/]+)/s=([^/]+)/[^/]+\.parquet$", ["lang", "source"])
    return f.groupBy("lang", "source").agg(F.count("*").alias("files"))


@query("SELECT r_name AS name, r_regionkey::VARCHAR AS key, 'a=b' AS odd, 3 AS entries FROM region")
def key_value_files(spark, d):
    """KEY=VALUE lines, split at the first sign; other lines are left out."""
    path = _path(spark, "commands")
    lines = F.concat(F.lit("NAME="), "r_name", F.lit("\nno sign here\nKEY="), F.col("r_regionkey").cast("string"), F.lit("\nODD=a=b"))
    files = table(spark, d, "region").select(F.col("r_regionkey").alias("of"), lines.alias("value"))
    files.repartition("of").write.partitionBy("of").text(path)  # a file for each region
    v = io.key_values(spark, f"{path}/*")
    at = lambda k: F.col("values")[k]
    return v.select(at("NAME").alias("name"), at("KEY").alias("key"), at("ODD").alias("odd"), F.size("values").alias("entries"))


@query("SELECT event_type AS run_id, event_id AS step, round(value, 6) AS value, user_id::DOUBLE AS user FROM events WHERE event_type IN ('click', 'error')")
def run_history(spark, d):
    """The wanted metrics of two runs from a service that gives pages of 1,000 steps, pages read in parallel."""
    e = table(spark, d, "events").select(F.col("event_type").alias("run_id"), F.col("event_id").alias("step"), F.round("value", 6).alias("value"), F.col("user_id").cast("double").alias("user"), F.lit(1.0).alias("other"))
    path = history.write_pages(e, "run_id", "step", _path(spark, "runs"))
    return history.read(spark, history.FolderClient(path), ["value", "user"]).where(F.col("run_id").isin("click", "error"))


@query(f"SELECT label, count(*) AS n, round(sum(e[1]), 4) AS first, true AS refused FROM {_E} GROUP BY 1")
def tensor_table(spark, d):
    """Vectors as arrays of floats in Parquet; a column that holds none is refused."""
    path = _path(spark, "tensors")
    table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("logits")).write.parquet(path)
    refused = _refused(lambda: io.read_tensors(spark, path, ["label"], ["vec_id"])) and _refused(lambda: io.read_tensors(spark, path, ["none"], ["vec_id"]))
    t = io.read_tensors(spark, path, ["logits"], ["label"])
    return t.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.get("logits", F.lit(0)).cast("double")), 4).alias("first")).withColumn("refused", F.lit(refused))


@query("SELECT '/runs/' || n_regionkey || '/m' || n_nationkey || '/x.csv' AS path, CASE WHEN n_nationkey % 4 = 0 THEN 'own ' || n_nationkey WHEN n_regionkey < 3 THEN 'region ' || n_regionkey ELSE 'top' END AS config FROM nation")
def nearest_configs(spark, d):
    """The configuration in the nearest folder above each file."""
    n = table(spark, d, "nation")
    folder = F.concat(F.lit("/runs/"), F.col("n_regionkey").cast("string"))
    own = F.concat(folder, F.lit("/m"), F.col("n_nationkey").cast("string"))
    configs = n.where("n_nationkey % 4 = 0").select(own.alias("dir"), F.concat_ws(" ", F.lit("own"), "n_nationkey").alias("config"))
    configs = configs.union(n.where("n_regionkey < 3").select(folder, F.concat_ws(" ", F.lit("region"), "n_regionkey")).distinct()).union(spark.range(1).select(F.lit("/runs"), F.lit("top")))
    return io.nearest_config(n.select(F.concat(own, F.lit("/x.csv")).alias("path")), configs)


@query("SELECT event_type AS s, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def append_log(spark, d):
    """A log that is only ever added to."""
    path = _path(spark, "log")
    e = table(spark, d, "events").select("event_type", "value", "event_id")
    for k in range(3):
        io.append(e.where(F.col("event_id") % 3 == k), path)
    return spark.read.parquet(path).groupBy(F.col("event_type").alias("s")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT n_name AS name, n_regionkey AS region, n_nationkey::VARCHAR AS csv_key, 0.5::DOUBLE AS lr FROM nation")
def paired_save(spark, d):
    """A result as Parquet and CSV, its configuration as JSON beside them."""
    path = _path(spark, "result")
    io.save_result(table(spark, d, "nation"), path, {"lr": 0.5, "name": "x"}, csv=True)
    config = io.read_json(spark, f"{path}/config", "lr double, name string").select("lr")
    csv = io.read_delimited(spark, f"{path}/csv", ["n_nationkey", "n_name"])
    back = spark.read.parquet(f"{path}/data").join(csv.select(F.col("n_nationkey").alias("csv_key"), F.col("n_name").alias("x")), F.col("n_name") == F.col("x"))
    return back.crossJoin(F.broadcast(config)).select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), "csv_key", "lr")  # one row


@query("SELECT '# Regions' || chr(10) || chr(10) || '| region | share |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_name || ' | ' || share || ' |', chr(10) ORDER BY r_name) || chr(10) AS report, true AS refused FROM (SELECT r_name, '0.2000' AS share FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)")
def markdown_report(spark, d):
    """A small table as Markdown; a large one is refused."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    x = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("region")).agg((F.count("*") / F.lit(25.0)).alias("share")).orderBy("region")
    try:
        io.markdown(n, "too long", 10)
        refused = False
    except ValueError:
        refused = True
    return spark.range(1).select(F.lit(io.markdown(x, "Regions")).alias("report"), F.lit(refused).alias("refused"))


@query("SELECT lang, count(*) AS n, false AS first_found, true AS second_found FROM documents GROUP BY 1")
def stored_stage(spark, d):
    """A stage is made once and read the second time."""
    path = _path(spark, "stage")
    make = lambda: table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    _, first = io.stored(spark, path, make)
    out, second = io.stored(spark, path, lambda: make().limit(0))
    return out.withColumns({"first_found": F.lit(first), "second_found": F.lit(second)})


def _drained(df, spark, name):
    """All that a stream gives for what is there now, as a table in the shared folder."""
    path = _path(spark, name)
    df.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _stream(spark, df, name):
    path = _path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _arriving(spark, df, order, name, **options):
    """A stream of a table's rows in two lots, the lower half of `order` first, some files at a time."""
    path = _path(spark, name)
    half = df.agg(F.percentile_approx(order, 0.5)).first()[0] or 0
    for lot in (F.col(order) <= half, F.col(order) > half):
        df.where(lot).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).options(**options).parquet(path)


@query(f"""WITH t AS (SELECT coalesce(source, '') AS source, doc_id // 400 AS lane, doc_id, unnest({DUCK_TOKENS}) AS tok, generate_subscripts({DUCK_TOKENS}, 1) AS p FROM documents), o AS (SELECT source, lane, tok, row_number() OVER (PARTITION BY source, lane ORDER BY doc_id, p) - 1 AS o FROM t)
SELECT source, lane, (o // 512)::BIGINT AS chunk_index, md5(string_agg(tok, ' ' ORDER BY o)) AS h FROM o GROUP BY 1, 2, 3 HAVING count(*) = 512""")
def stream_chunks(spark, d):
    """Token arrays of a stream, joined in order and cut every 512, over several micro-batches, tasks and lanes of 400 ids."""
    x = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", tokens().alias("tok"))
    x = x.repartition(4, "source")  # a lot's rows of a source in one file
    out = _drained(streams.rechunk(_arriving(spark, x, "doc_id", "tokens", maxFilesPerTrigger=3), "source", "doc_id", "tok", 512, 400), spark, "chunks")
    return out.select("source", "lane", "chunk_index", F.md5(F.array_join("token_ids", " ")).alias("h"))


@query("WITH c AS (SELECT event_type, event_id, sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cum FROM events) SELECT event_type AS source, t.t::DOUBLE AS mark, min(event_id) AS at FROM c JOIN (SELECT unnest([100, 1000, 10000]) AS t) t ON cum >= t.t GROUP BY 1, 2")
def stream_thresholds(spark, d):
    """The events at which a stream's running sums reach marks."""
    e = table(spark, d, "events").select("event_type", "event_id", "value").repartition(4, "event_type")
    return _drained(streams.threshold_events(_arriving(spark, e, "event_id", "sums", maxFilesPerTrigger=3), "event_type", "event_id", "value", [100.0, 1000.0, 10_000.0]), spark, "marks")


@query(f"SELECT DISTINCT lang, {DUCK_PRINT} AS h FROM documents WHERE text IS NOT NULL")
def stream_first_seen(spark, d):
    """Normalised texts of a stream that were not there before, in the same or an earlier micro-batch."""
    x = table(spark, d, "documents").select("doc_id", "lang", T.fingerprint(F.col("text")).alias("h")).where("h is not null")
    x = x.withColumn("key", F.concat_ws(":", "lang", "h"))
    return _drained(streams.first_seen(_arriving(spark, x, "doc_id", "texts", maxFilesPerTrigger=1), "key").select("lang", "h"), spark, "seen")


@query("SELECT 'train' AS event, event_type AS s, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_metric_log(spark, d):
    """An append-only log of a stream's batches with their label."""
    path = _path(spark, "metrics")
    e = table(spark, d, "events").select("event_type", "value")
    streams.log_metrics(_stream(spark, e, "events"), path, f"{path}-state", "train").awaitTermination()
    return spark.read.parquet(path).groupBy("event", F.col("event_type").alias("s")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT q.vec_id AS q, c.vec_id AS c, round(list_dot_product(q.e, c.e), 5) AS score FROM {_E} q, {_E} c WHERE q.vec_id % 20 = 0")
def stream_scores(spark, d):
    """Streamed queries against a fixed table of candidates."""
    e = tiles.records(table(spark, d, "embeddings"), "vec_id", F.col("embedding"), 64)
    path = _path(spark, "scores")
    streams.score_stream(_stream(spark, e.where("id % 20 = 0"), "queries"), e, 64, 5, path).awaitTermination()
    return spark.read.schema("q bigint, c bigint, score double, batch int").parquet(path).drop("batch")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events)")
def stream_windows(spark, d):
    """Sums by day of event time with a watermark; a day is given out once the watermark has passed it, late rows are dropped."""
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    w = streams.windowed(_stream(spark, e, "events"), "ts", "1 day", "0 seconds", ["event_type"], "value")
    out = _drained(w, spark, "windows")
    last = e.agg(F.date_trunc("day", F.max("ts")).alias("last"))
    out = out.crossJoin(F.broadcast(last)).where("begin < last")  # one row
    return out.select("event_type", F.col("begin").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))
