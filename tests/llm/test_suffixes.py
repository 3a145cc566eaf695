"""Removal of repeated substrings against every substring in a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplework.llm import suffixes

SCHEMA = "doc_id bigint, text string, seg int, block bigint, spans string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = [i for i in range(len(b)) if gone[i] != (i > 0 and gone[i - 1])]
        kept = bytes(c for i, c in enumerate(b) if not gone[i])
        out.append((len(b), int(gone[: len(b)].sum()), int(sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))), hashlib.sha256(kept).hexdigest()))
        assert len(spans) >= out[-1][2]
    return out


def made(seed, length):
    rng = random.Random(seed)
    text = lambda n, letters="abcdefghij é語\n": "".join(rng.choice(letters) for _ in range(n))
    passage, licence = text(3 * length), text(length)
    out = [None, "", "x", text(length - 1), passage, passage[: length // 2 + 3], "a" * 900, "ab" * 300, "a" * (length - 1) + "\x00" * 40, text(2000)]
    for _ in range(30):
        near = list(passage)
        near[rng.randrange(len(near))] = "Q"
        out.append(text(rng.randrange(120)) + "".join(near) + text(rng.randrange(60)))
        out.append(text(rng.randrange(200)) + licence[: length - rng.randrange(4)] + text(rng.randrange(200)))
        out.append(text(rng.randrange(30), "ab") * 3 + "\x00" * rng.randrange(2 * length))
    a = text(1500)
    out += [a, a, a[:700] + "#" + a[700:], a[5:], text(400, "ab"), text(4000, "ab "), passage * 3, licence, licence]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("length", "hot", "block"), [(40, 50_000, 1 << 20), (40, 3, 1 << 20), (40, 50_000, 257), (64, 5, 1000), (9, 10, 5000), (201, 50_000, 1 << 16)])
def test_against_every_substring(spark, length, hot, block):
    texts = made(length + hot, length)
    rows = [(i % 70 if i % 9 else None, t, 1, 2, "s") for i, t in enumerate(texts)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), length=length, hot=hot, block=block)
    got = got.select("id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"), "spans").collect()
    want = sorted((repr(r[0]), *b) for r, b in zip(rows, brute(texts, length)))
    assert sorted((repr(r["id"]), *r[1:5]) for r in got) == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["r"] for r in got)


def test_empty_and_short(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    got = suffixes.remove_repeats(spark.createDataFrame([(1, None, 0, 0, ""), (2, "", 0, 0, ""), (3, "é" * 99, 0, 0, ""), (3, "é" * 99, 0, 0, "")], SCHEMA)).collect()
    assert sorted((r["id"], r["n_bytes"], r["spans"]) for r in got) == [(1, 0, []), (2, 0, []), (3, 198, []), (3, 198, [])]


def test_order_of_strings_with_common_lengths():
    rows = [b"ab", b"ab\0", b"abc", b"", b"b", b"ab\0\0", b"ab"]
    m = np.zeros((len(rows), 4), np.uint8)
    for r, x in zip(m, rows):
        r[: len(x)] = list(x)
    by, common = suffixes._sorted_with_common(m, np.array([len(r) for r in rows]))
    assert [rows[i] for i in by] == sorted(rows) and common.tolist() == [-1, 0, 2, 2, 3, 2, 0]
