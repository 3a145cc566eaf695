"""Paged run histories of a tracking service as a data source.

A service lists runs and gives a run's rows in pages, for the keys asked for. Every page is a partition, so pages are
fetched in parallel and a lost one is fetched again; equality on `run_id` is pushed down, so other runs' pages are not
even listed.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import unquote, urlparse

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ripplework.operators.core import ranges
from ripplework.session import materialize

PAGE = 1000


class Client(Protocol):
    """What a tracking service must offer; it is sent to the tasks."""

    def runs(self) -> list[str]: ...

    def pages(self, run: str) -> int: ...

    def page(self, run: str, number: int, keys: list[str]) -> list[tuple]:
        """(step, a value or None for each key) of each row that has one of the keys."""
        ...


@dataclass
class FolderClient:
    """A service whose pages are JSON lines under root/run_id=.../page=..., a folder that driver and tasks can open."""

    root: str

    def _folder(self, *parts: str) -> str:
        return os.path.join(urlparse(self.root).path if "://" in self.root or self.root.startswith("file:") else self.root, *parts)

    def _runs(self) -> dict[str, str]:
        return {unquote(x.removeprefix("run_id=")): x for x in sorted(os.listdir(self._folder())) if x.startswith("run_id=")}

    def runs(self) -> list[str]:
        return list(self._runs())

    def pages(self, run: str) -> int:
        return sum(x.startswith("page=") for x in os.listdir(self._folder(self._runs()[run])))

    def page(self, run: str, number: int, keys: list[str]) -> list[tuple]:
        out, folder = [], self._folder(self._runs()[run], f"page={number}")
        for name in sorted(os.listdir(folder)):
            if name.startswith("part-"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    rows = [json.loads(line) for line in f]
                out += [(r["step"], *[None if r.get(k) is None else float(r[k]) for k in keys]) for r in rows if any(r.get(k) is not None for k in keys)]
        return out


@dataclass
class _Page(InputPartition):
    run: str
    number: int


class _Reader(DataSourceReader):
    def __init__(self, client: Client, keys: list[str]):
        self.client, self.keys, self.only = client, keys, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("run_id",):
                want = set(f.value) if isinstance(f, In) else {f.value}
                self.only = want if self.only is None else self.only & want
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        runs = [r for r in self.client.runs() if self.only is None or r in self.only]
        return [_Page(r, n) for r in runs for n in range(self.client.pages(r))]

    def read(self, partition: InputPartition):
        for row in self.client.page(partition.run, partition.number, self.keys):
            yield (partition.run, *row)


class PagedHistory(DataSource):
    """Options: `client` (pickled, hexadecimal) and `keys` (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "paged_history"

    def schema(self) -> str:
        return "run_id string, step bigint" + "".join(f", `{k}` double" for k in json.loads(self.options["keys"]))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(cloudpickle.loads(bytes.fromhex(self.options["client"])), json.loads(self.options["keys"]))


def read(spark: SparkSession, client: Client, keys: list[str]) -> DataFrame:
    """(run_id, step, keys): the rows of all runs that have one of the keys; filters on run_id reach the service."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedHistory)
    return spark.read.format("paged_history").options(client=cloudpickle.dumps(client).hex(), keys=json.dumps(keys)).load()


def write_pages(df: DataFrame, run: str, order: str, path: str, page: int = PAGE) -> str:
    """Writes a table as a service's pages: `page` rows of a run, in order, for each; numbered over ranges, not in one task."""
    dealt = ranges(df, run, order, rows=100_000)
    n = dealt.groupBy(run, "__part").agg(F.count("*").alias("__n"))
    n = n.select(run, "__part", (F.sum("__n").over(W.partitionBy(run).orderBy("__part")) - F.col("__n")).alias("__b"))  # a row for each range
    at = F.row_number().over(W.partitionBy(run, "__part").orderBy(order)) - 1
    rows = materialize(dealt.withColumn("__i", at).join(n, [run, "__part"]), "numbered")
    rows = rows.withColumn("page", F.floor((F.col("__b") + F.col("__i")) / page)).drop("__i", "__b", "__part").withColumnRenamed(run, "run_id")
    rows.repartition("run_id", "page").write.partitionBy("run_id", "page").json(path)
    return path
