"""Streaming forms give what their batch forms give."""

import random

from pyspark.sql import functions as F

from ripplework.sources import history, io
from ripplework.streaming import streams


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def source(spark, tmp_path):
    rows = [("a", i, float(i), [f"t{i}", "x"]) for i in range(6)] + [("b", i, 1.0, ["y"]) for i in range(3)]
    spark.createDataFrame(rows, "s string, o long, v double, w array<string>").coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema("s string, o long, v double, w array<string>").parquet(f"{tmp_path}/in")


def test_thresholds(spark, tmp_path):
    got = sorted(drain(streams.threshold_events(source(spark, tmp_path), "s", "o", "v", [1.0, 5.0]), "marks"))
    assert got == [("a", 1.0, 1), ("a", 5.0, 3), ("b", 1.0, 0)]


def test_rechunk(spark, tmp_path):
    got = sorted(drain(streams.rechunk(source(spark, tmp_path), "s", "o", "w", 4), "chunks"))
    assert got == [("a", 0, i, [f"t{2 * i}", "x", f"t{2 * i + 1}", "x"]) for i in range(3)]


def test_state_over_micro_batches(spark, tmp_path):
    """Open chunks, sums and marks are carried from file to file, lanes apart."""
    rng, rows = random.Random(6), []
    for i in range(90):
        rows.append((rng.choice("ab"), i, rng.choice((0.0, 1.5, None, 4.0)), [f"t{i}.{j}" for j in range(rng.randrange(7))] if i % 8 else None))
    schema = "s string, o long, v double, w array<string>"
    for at in range(0, 90, 30):
        part = rows[at : at + 30]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    make = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted(drain(streams.rechunk(make(), "s", "o", "w", 5, 40), "lanes"))
    want = []
    for s in "ab":
        for lane in range(3):
            tok = [t for a, o, _, w in sorted(rows, key=lambda r: r[1]) if a == s and o // 40 == lane for t in w or ()]
            want += [(s, lane, k, tok[5 * k : 5 * k + 5]) for k in range(len(tok) // 5)]
    assert got == want and len(want) > 10
    marks, want = [0.5, 20.0, 21.0, 60.0, 900.0], []
    for s in "ab":
        total, left = 0.0, list(marks)
        for a, o, v, _ in sorted(rows, key=lambda r: r[1]):
            total += (v or 0.0) if a == s else 0.0
            while a == s and left and total >= left[0]:
                want.append((s, left.pop(0), o))
    assert sorted(drain(streams.threshold_events(make(), "s", "o", "v", marks), "sums")) == sorted(want)


def test_history_reads_only_the_pages_of_the_runs_asked_for(spark, tmp_path):
    rows = [(f"run {i % 3}/x", i, i / 2 if i % 5 else None, "no") for i in range(400)]
    path = history.write_pages(spark.createDataFrame(rows, "run_id string, step long, loss double, note string"), "run_id", "step", f"{tmp_path}/runs", 50)

    class Counting(history.FolderClient):
        def pages(self, run):
            with open(f"{tmp_path}/asked", "a") as f:
                f.write(run + "\n")
            return super().pages(run)

    df = history.read(spark, Counting(path), ["loss"])
    assert df.rdd.getNumPartitions() == 9
    assert sorted(map(tuple, df.collect())) == sorted((r, s, v) for r, s, v, _ in rows if v is not None)
    (tmp_path / "asked").unlink()
    one = df.where("run_id = 'run 1/x'").collect()
    assert sorted(map(tuple, one)) == [(r, s, v) for r, s, v, _ in rows if v is not None and r == "run 1/x"]
    assert set((tmp_path / "asked").read_text().split("\n")) == {"run 1/x", ""}


def test_first_seen(spark, tmp_path):
    assert sorted(r[0] for r in drain(streams.first_seen(source(spark, tmp_path), "s").select("s"), "seen")) == ["a", "b"]


def test_files(spark, tmp_path):
    (tmp_path / "run.txt").write_text("A=1\nnothing\nB=x=y\n")
    assert io.key_values(spark, f"{tmp_path}/run.txt").first()["values"] == {"A": "1", "B": "x=y"}
    m = io.manifest(spark, str(tmp_path))
    assert m.count() == 1 and io.manifest_diff(m, m).count() == 0 and io.manifest_diff(m, m.limit(0)).count() == 1
    files = spark.createDataFrame([("/r/a/b/f",), ("/r/c/f",)], "path string")
    cfg = spark.createDataFrame([("/r", "top"), ("/r/a", "near")], "dir string, config string")
    assert {r["path"]: r["config"] for r in io.nearest_config(files, cfg).collect()} == {"/r/a/b/f": "near", "/r/c/f": "top"}
    df, name = io.first_available([("no", lambda: spark.read.parquet(f"{tmp_path}/none")), ("yes", lambda: spark.range(1))])
    assert name == "yes" and df.count() == 1
    assert io.layered({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}, "b": {}}) == {"a": {"x": 1, "y": 3}, "b": {}}
    assert io.discover(spark, str(tmp_path), r"/(run)\.(txt)$", ["stem", "kind"]).select("stem", "kind").first() == ("run", "txt")
    spark.createDataFrame([(1, "a,\"b\"")], "i int, t string").select(F.col("i").cast("string").alias("i"), "t").write.option("header", True).option("escape", '"').option("sep", "\t").csv(f"{tmp_path}/tsv")
    assert io.read_delimited(spark, f"{tmp_path}/tsv", ["t", "i"], "\t", ("i",)).first() == ('a,"b"', 1.0)
