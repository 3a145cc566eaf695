"""Every query with a DuckDB twin gives the same rows on the smallest fixtures."""

import math
from pathlib import Path

import duckdb
import pytest

from ripplework.plans.catalogue import oracle_sql, queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no fixtures")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(map(plain, r))) for r in df.select(*cols).collect())
    if name not in oracle_sql():
        assert ours
        return
    r = duck.sql(oracle_sql()[name])
    assert sorted(r.columns) == cols
    assert ours == sorted(repr(tuple(map(plain, x))) for x in r.select(*[f'"{c}"' for c in cols]).fetchall())
