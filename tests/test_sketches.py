"""Stored sketches against exact counts and quantiles; streams that stop early."""

import random

from pyspark.sql import functions as F

from ripplework.operators import sketches
from ripplework.sources import io


def test_roll_up_of_stored_sketches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randrange(5), rng.randrange(3000), rng.gauss(0, 1)) for _ in range(20_000)] + [("none", 0, None, None)]
    df = spark.createDataFrame(rows, "g string, day int, u long, v double")
    sketches.sketched(df, ["g", "day"], "u", "v").write.parquet(f"{tmp_path}/cells")
    stored = spark.read.parquet(f"{tmp_path}/cells")
    for keys in (["g"], ["day"], []):
        for r in sketches.rolled_up(stored, keys).collect():
            mine = [x for x in rows if all(x[("g", "day").index(k)] == r[k] for k in keys)]
            assert r["rows"] == len(mine)
            exact = len({x[2] for x in mine} - {None})
            assert abs(r["distinct"] - exact) <= 0.06 * exact
            v = sorted(x[3] for x in mine if x[3] is not None)
            if not v:
                assert r["q50"] is None
                continue
            for q, name in ((0.5, "q50"), (0.9, "q90")):
                assert abs(sum(x <= r[name] for x in v) / len(v) - q) < 0.03
    direct = sketches.rolled_up(sketches.sketched(df, ["g"], "u", "v"), ["g"]).where("g = 'a'").first()
    merged = sketches.rolled_up(stored, ["g"]).where("g = 'a'").first()
    assert abs(direct["distinct"] - merged["distinct"]) <= 0.04 * direct["distinct"]


def test_first_rows_of_a_stream(spark, tmp_path):
    for i in range(10):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got, files = io.first_rows_streamed(spark, f"{tmp_path}/in", "id long", 25)
    assert sorted(r["id"] for r in got.collect()) == list(range(25)) and files < 10
    every, files = io.first_rows_streamed(spark, f"{tmp_path}/in", "id long", 1000)
    assert every.count() == 100 and files == 10
    none, files = io.first_rows_streamed(spark, f"{tmp_path}/in", "id long", 0)
    assert none.count() == 0 and files == 0
    kept, _ = io.first_rows_streamed(spark, f"{tmp_path}/in", "id long", 4, where=F.col("id") % 7 == 0)
    assert sorted(r["id"] for r in kept.collect()) == [0, 7, 14, 21]
