"""Secret scans over an incremental blob ledger. Native: DataFrame functions only.

Every version of a text is content-addressed (SHA-256). A ledger is a Parquet folder of (blob, rules version, findings)
for what has been scanned; a scan reads only the pairs the ledger lacks, once per blob however many paths hold it,
appends them, and findings are joined back to all paths. The rules version is a hash of the rules, so other rules see
every blob as unseen.

Spans are found in time linear in the text (but for a small power of its matches, see `spans`).

Defined results: null text is the empty blob, without findings; equal texts share one scan; a null or repeated path keeps
a row for each version; an empty table gives an empty result. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import uuid
import zlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.session import shared_dir, table

#: kind, pattern, group that counts, least length of that group. The first three are the base rules.
BASE_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a maximal run of 24 or more is the same match as a run filtered by length
)
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("bearer", r"(?:ghp|gho|ghs|github_pat|xox[abp]|sk_live)[_-][A-Za-z0-9_-]+", 0, 20),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 30),
)
#: A cheap test that every text with a match passes.
HINTS = {"assign": r"(?i:pass(?:word|wd)|secret|token|api_?key)", "access": r"AKIA", "hex": r"[0-9a-f]{24}", "pem": r"PRIVATE KEY", "bearer": r"(?:gh[pos]|github_pat|xox[abp]|sk_live)[_-]", "jwt": r"eyJ"}
RULES = BASE_RULES + MORE_RULES
#: Matches that one running sum covers.
RUN = 256
SPAN = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"


def rules_version(rules=RULES) -> int:
    """A number that changes with any rule."""
    return zlib.crc32(repr(rules).encode()) & 0x7FFFFFFF


def _bind(value: Column, use) -> Column:
    """use(value), with the value taken once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, kind: str, pattern: str, group: int, least: int, order: int) -> Column:
    """Spans of one rule, leftmost and non-overlapping: the lengths of matches and of what lies between give the offsets.

    Offsets are running sums in two levels, inside runs of `RUN` matches and over the runs: an array that grows by one is
    copied each time, so one sum over n matches would cost n^2.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    size = lambda x: F.length(x).cast("bigint")
    rows = F.transform(F.arrays_zip(hits.alias("hit"), counted.alias("part"), F.split(text, pattern, -1).alias("gap")), lambda x: F.struct(size(x["gap"]).alias("gap"), size(x["hit"]).alias("hit"), (F.length(x["part"]) >= least).alias("ok")))
    rows = F.filter(rows, lambda x: x["hit"].isNotNull())  # the gap behind the last match has none

    def run(part: Column) -> Column:  # (length, spans from its start) of a run of matches
        start = lambda s, x: s["at"] + x["gap"]
        one = lambda s, x: F.struct(start(s, x).alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (start(s, x) + x["hit"]).alias("end"))
        first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(part, first, lambda s, x: F.struct((start(s, x) + x["hit"]).alias("at"), F.when(x["ok"], F.concat(s["out"], F.array(one(s, x)))).otherwise(s["out"]).alias("out")))

    def shifted(runs: Column) -> Column:
        first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        begins = F.aggregate(runs, first, lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        move = lambda r, at: F.transform(r["out"], lambda x: F.struct((x["start"] + at).alias("start"), x["ord"].alias("ord"), x["kind"].alias("kind"), (x["end"] + at).alias("end")))
        return F.flatten(F.zip_with(runs, begins, move))

    cut = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / RUN).cast("int")), lambda i: run(F.slice(r, i * RUN + 1, RUN)))
    found = _bind(rows, lambda r: F.when(F.size(r) > 0, _bind(cut(r), shifted)).otherwise(F.array().cast(SPAN)))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rules_version, found) from (blob, text); found is sorted by start, then by the rules' order."""
    found = reduce(F.concat, [spans(F.col("text"), *r, i) for i, r in enumerate(rules)])
    return blobs.select("blob", F.lit(rules_version(rules)).alias("rules_version"), F.sort_array(found).alias("found"))


def new_ledger(spark: SparkSession) -> str:
    """The path of a ledger that nothing has been written to, in the shared folder."""
    return f"{shared_dir(spark)}/ripplework/ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, rules_version, found) of all that was scanned; empty if the ledger is not there yet."""
    columns = {"blob": "binary", "rules_version": "int", "found": SPAN}
    try:
        return spark.read.schema(", ".join(f"{c} {t}" for c, t in columns.items())).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def update_ledger(versions: DataFrame, ledger: str, path_col: str = "path", text_col: str = "text", rules=RULES) -> DataFrame:
    """Scans the blobs the ledger lacks under these rules, appends them to it, and returns (path, blob) of every version.

    Copies collapse before the shuffle. An append is one job, which is there whole or not at all; two writers at once may
    scan a blob twice, which `findings` allows for.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = versions.select(F.col(path_col).alias("path"), text.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    suspect = reduce(lambda a, b: a | b, [F.col("text").rlike(HINTS[r[0]]) for r in rules])
    done = read_ledger(versions.sparkSession, ledger).where(F.col("rules_version") == rules_version(rules)).select("blob")
    unseen = rows.select("blob", F.when(suspect, F.col("text")).otherwise(F.lit("")).alias("text")).join(done, "blob", "left_anti")
    scan(unseen.dropDuplicates(["blob"]), rules).write.mode("append").parquet(ledger)
    return rows.select("path", "blob")


def findings(paths: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """(path, blob, found) for every version from the ledger. Blobs without findings take no part in the join."""
    known = read_ledger(paths.sparkSession, ledger).where((F.col("rules_version") == rules_version(rules)) & (F.size("found") > 0))
    hits = known.select("blob", "found").dropDuplicates(["blob"])
    return paths.join(hits, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(SPAN)))


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Two versions of a history in turn, even ids, then odd ones: the second scans what the first has not shown."""
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), new_ledger(spark)
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    paths = [update_ledger(docs.where(part), ledger, "doc_id") for part in (even, ~even)]
    f = findings(paths[0].unionByName(paths[1]), ledger)
    base = F.filter("found", lambda x: x["ord"] < len(BASE_RULES))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(r[0]) for r in BASE_RULES]
    return f.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
