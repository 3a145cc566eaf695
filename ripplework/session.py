"""Session settings and the few helpers every module shares."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = ("__file", "__row")


def build_session(app: str = "ripplework", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution. On a cluster leave `master` unset."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("RIPPLEWORK_DRIVER_MEMORY", "12g"))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture table; works for any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; on one machine (tests), one of our own where that is unset."""
    d = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = os.path.join(tempfile.gettempdir(), f"ripplework-{os.getpid()}")
    return d.rstrip("/")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """table() with the place of each row, PLACE: its file and its number there."""
    return table(spark, sf_dir, name).select("*", F.col("_metadata.file_name").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


class _Written(threading.local):
    """Tables written by materialize() in this thread, oldest first: another thread's are not ours to delete."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = _Written()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ripplework/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for discard()."""
    return len(_WRITTEN.paths)


def discard(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Deletes the tables written after the mark but for the last `keep`; nothing may read them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = slice(since, max(since, len(_WRITTEN.paths) - keep))
    for path in _WRITTEN.paths[gone]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del _WRITTEN.paths[gone]
