"""Readers and writers. Schemas are given, never inferred; paths go through Spark only."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.session import materialize, shared_dir


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines of a file, folder or glob, blank lines skipped (S02, S04); strict: a bad line fails the read.

    A bad line is one that is no JSON object. The error shows the line and its file: a line number would take a count of
    all lines before it.
    """
    if not strict:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    bad = ~F.coalesce(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull(), F.lit(False))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no JSON object in "), "file", F.lit(": "), F.substring("value", 1, 200)))).otherwise(row)
    return raw.select(checked.alias("row")).select("row.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",", numeric: tuple[str, ...] = ()) -> DataFrame:
    """CSV or TSV with a header, gzipped or not, as strings; `numeric` columns become doubles, null if they are none.

    A missing column raises.
    """
    df = spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {lost}")
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in columns])


def first_available(candidates: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame, str]:
    """The first source that opens, and its name; all errors if none does."""
    errors = []
    for name, load in candidates:
        try:
            return load(), name
        except AnalysisException as e:
            errors.append(f"{name}: {str(e).splitlines()[0]}")
    raise FileNotFoundError("; ".join(errors))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(path, values): KEY=VALUE lines of each file as a map, split at the first `=`."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("l"))
    pairs = F.transform(F.filter("l", lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, r"^[^=]*=", "").alias("v")))
    return raw.select("path", F.map_from_entries(pairs).alias("values"))


def layered(defaults: dict, override: dict) -> dict:
    """Specs merged key by key, one level down."""
    return {k: {**defaults.get(k, {}), **override.get(k, {})} for k in {**defaults, **override}}


def discover(spark: SparkSession, root: str, pattern: str, names: list[str]) -> DataFrame:
    """(path, size, modified, names...): files under a root whose path fits a regex, its groups as columns."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    files = files.where(F.col("path").rlike(pattern))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, config): the config in the nearest folder above each path, from (path) and (dir, config)."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = files.select("path", F.explode(dirs).alias("dir"))
    return up.join(configs, "dir").groupBy("path").agg(F.max_by("config", F.length("dir")).alias("config"))


def read_split(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """A dataset folder whose parts are `split=...` folders; with a split, only that folder is read."""
    df = spark.read.parquet(root)
    return df if split is None else df.where(F.col("split") == split).drop("split")


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows of a source in its own order, which is a column."""
    return df.orderBy(order).limit(n)


def first_rows_streamed(spark: SparkSession, path: str, schema: str, n: int, files: int = 1, where: Column | None = None) -> tuple[DataFrame, int]:
    """(the first n rows of a folder of Parquet files in the order in which they were written, files read).

    A stream takes `files` files a micro-batch and is stopped once n rows that pass `where` stand, so what lies beyond is
    never opened. Rows of a file keep its order.
    """
    out = f"{shared_dir(spark)}/ripplework/first-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    names = stream.columns
    rows = stream.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    done, held, read = threading.Event(), [0], set()

    def take(batch: DataFrame, epoch: int) -> None:
        if done.is_set():
            return
        batch = materialize(batch.withColumn("__epoch", F.lit(epoch)), "micro-batch")
        read.update(r[0] for r in batch.select("__file").distinct().collect())  # at most `files`
        kept = batch if where is None else batch.where(where)
        kept.write.mode("append").parquet(out)
        held[0] += kept.count()
        if held[0] >= n:
            done.set()

    if n > 0:
        query = rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        while query.isActive and not done.wait(0.1):
            pass
        query.stop() if done.is_set() else query.awaitTermination()
    if not held[0]:
        return spark.createDataFrame([], schema), len(read)
    got = spark.read.schema(f"{schema}, __file string, __row bigint, __epoch int").parquet(out)
    return got.orderBy("__epoch", "__file", "__row").limit(n).select(*names), len(read)


class Registry:
    """Named datasets and their aliases; `limit` takes that many rows in the order of a seeded hash."""

    def __init__(self):
        self.loaders: dict[str, Callable[[], DataFrame]] = {}

    def add(self, load: Callable[[], DataFrame], name: str, *aliases: str) -> None:
        for x in (name, *aliases):
            self.loaders[x.strip().lower()] = load

    def load(self, name: str, key: str | None = None, limit: int | None = None, seed: int = 0) -> DataFrame:
        if name.strip().lower() not in self.loaders:
            raise ValueError(f"unknown dataset {name}; known: {sorted(self.loaders)}")
        df = self.loaders[name.strip().lower()]()
        if limit is None:
            return df
        return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(limit)


def _scalar(x: str):
    if x[:1] in "\"'" and x[-1:] == x[:1] and len(x) > 1:
        return x[1:-1]
    if x.startswith("[") and x.endswith("]"):
        return [_scalar(y.strip()) for y in x[1:-1].split(",") if y.strip()]
    if x.lower() in ("true", "false", "null", "~", ""):
        return {"true": True, "false": False}.get(x.lower())
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return x


def parse_yaml(text: str) -> dict:
    """Nested mappings, lists of scalars, inline lists and scalars: what configuration files use of YAML."""
    root: dict = {}
    open_: list[tuple[int, object, object]] = [(-1, root, None)]  # indent, container, and where it hangs
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not body.strip() or body.strip() == "---":
            continue
        indent, body = len(body) - len(body.lstrip()), body.strip()
        item = body == "-" or body.startswith("- ")
        while open_[-1][0] >= indent and not (item and open_[-1][0] == indent and (isinstance(open_[-1][1], list) or open_[-1][1] == {})):
            open_.pop()
        _, at, _ = open_[-1]
        if item:
            if isinstance(at, dict):
                holder, key = open_[-1][2]
                holder[key] = at = []
                open_[-1] = (indent, at, None)
            at.append(_scalar(body[1:].strip()))
            continue
        key, sep, value = body.partition(":")
        if not sep or not isinstance(at, dict):
            raise ValueError(f"not understood: {line}")
        key, value = str(_scalar(key.strip())), value.strip()
        at[key] = _scalar(value) if value else {}
        if not value:
            open_.append((indent, at[key], (at, key)))
    return root


def read_yaml(spark: SparkSession, path: str) -> dict:
    """One configuration file as a dict; read through Spark, so from any store."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one file wanted at {path}")
    return parse_yaml(rows[0][0])


def run_history(history: DataFrame, run: str, keys: list[str]) -> DataFrame:
    """(step, keys) of a run from a table (run_id, step, key, value) that stands in for a tracking service."""
    rows = history.where((F.col("run_id") == run) & F.col("key").isin(keys))
    return rows.groupBy("step").pivot("key", keys).agg(F.max("value"))


def read_tensors(spark: SparkSession, path: str, vectors: list[str], ids: list[str]) -> DataFrame:
    """Tables of vectors, kept as array<float> columns of Parquet (S20); another type or a missing column raises."""
    df = spark.read.parquet(path)
    kinds = dict(df.dtypes)
    if bad := [c for c in vectors if kinds.get(c) not in ("array<float>", "array<double>")] + [c for c in ids if c not in kinds]:
        raise ValueError(f"columns missing or no vectors: {bad}")
    return df.select(*ids, *vectors)


def save_result(df: DataFrame, path: str, config: dict, csv: bool = False) -> None:
    """A result as Parquet, on demand as CSV too, with its configuration as JSON beside it."""
    import json

    df.write.parquet(f"{path}/data")
    if csv:
        write_csv([df], f"{path}/csv")
    df.sparkSession.range(1).select(F.lit(json.dumps(config, sort_keys=True)).alias("value")).coalesce(1).write.text(f"{path}/config")


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as a Markdown report; one of more than `most` rows raises."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """A stage's result, and whether it was there: what is stored and whole is read, else it is made and written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    found = mark.getFileSystem(conf).exists(mark)
    if not found:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), found


def write_jsonl(df: DataFrame, path: str, sort_keys: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines; an existing output is refused unless mode says otherwise."""
    (df.select(*sorted(df.columns)) if sort_keys else df).write.mode(mode).json(path)


def write_csv(frames: list[DataFrame], path: str, mode: str = "errorifexists") -> None:
    """CSV with the union of the frames' columns, first seen first."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append(df: DataFrame, path: str) -> None:
    """Append-only log."""
    df.write.mode("append").parquet(path)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(name, bytes, sha256) of every file under a root, sorted."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("name")


def manifest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names that only one manifest has, or whose size or digest differ."""
    j = a.alias("a").join(b.alias("b"), "name", "full_outer")
    return j.where(~(F.col("a.sha256").eqNullSafe(F.col("b.sha256")) & F.col("a.bytes").eqNullSafe(F.col("b.bytes")))).select("name")
