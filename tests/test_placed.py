"""Sums of doubles add up in the order of the table, as the twins do on one thread, however the table is dealt to tasks."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ripplework.operators import records as R
from ripplework.plans.catalogue import oracle_sql, queries
from ripplework.session import PLACE, placed


def compared(spark, path, table, name):
    """Rows of the query and of its twin on one thread, on a table of many small row groups read by many tasks."""
    pq.write_table(table, path / f"{name}.parquet", row_group_size=97)
    conf = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    query = {"lineitem": "cancellation", "events": "domain_accumulator"}[name]
    twin = c.sql(oracle_sql()[query])
    try:
        ours = queries()[query](spark, str(path)).select(*twin.columns).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    return sorted(map(repr, map(tuple, ours))), sorted(map(repr, twin.fetchall()))


def test_cancellation(spark, tmp_path):
    r, n = np.random.default_rng(1), 7 * 40 * 60
    at, beside = r.permutation(n), [1e17, -1e17, 0.5, -3.0, -30.0, -11.0]  # what is lost beside 1e17 depends on the order
    t = pa.table({"l_orderkey": at % 40, "l_linenumber": pa.array(at // 40 % 7 + 1, pa.int32()), "l_quantity": np.ones(n), "l_extendedprice": r.integers(100, 9_000_000, n) / 100, "l_discount": np.array(beside)[at // 280 % 6]})
    ours, twin = compared(spark, tmp_path, t, "lineitem")
    assert ours == twin


def test_domain_accumulator(spark, tmp_path):
    r, n = np.random.default_rng(2), 20_000
    kinds = np.array(["click", "error", "view"])
    v = pa.array(r.integers(0, 50_000, n) / 100, mask=r.random(n) < 0.05)
    ours, twin = compared(spark, tmp_path, pa.table({"user_id": r.integers(0, 1500, n), "event_type": kinds[r.integers(0, 3, n)], "value": v}), "events")
    assert ours == twin


def test_large_groups_by_ranges(spark, tmp_path):
    v = np.array([1e16, 1.0, 1.0, 1.0, -1e16, 1.0, 3.0, 5.0])
    pq.write_table(pa.table({"k": [1, 1, 1, 1, 1, 1, None, None], "d": ["a"] * 7 + [None], "v": v}), tmp_path / "x.parquet", row_group_size=2)
    x = placed(spark, str(tmp_path), "x")
    mean = lambda most: {r["k"]: r["mean"] for r in R.domain_accumulator(x.where(F.col("d").isNotNull()), "k", "d", "v", PLACE, most).collect()}
    assert mean(6) == {1: 1.0 / 6, None: 3.0}  # every 1.0 but the last is lost beside 1e16
    assert mean(3) == {1: ((1e16 + 1.0 + 1.0) + (1.0 - 1e16 + 1.0)) / 6, None: 3.0}
