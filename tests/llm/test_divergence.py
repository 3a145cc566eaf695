"""The divergence audit against whole numbers in plain Python, with many blocks, chunks and spans."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ripplework.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, chunk int, rank int"


def brute(rows, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    df, tf, by, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        w = terms(text)
        df[lang].update(set(w))
        tf[lang].update(w)
        by[lang, source].update(w)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= 3]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        q, ps = share(tf[lang]), {s: share(by[lang, s]) for s in sources}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pair = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(ps[s][t], q[t]), t.encode(), t) for t in kept if by[lang, s][t] and ps[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pair), 1)}
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(term)[:top], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdEFGHéß語") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    sep = [" ", "\n", "-", "1", "\x00", "_", "{", "\x7f"]
    out = [(None, "en", "a"), ("", "en", "silent"), ("12 34", None, None), ("x y x", "xx", "p"), ("y z", "xx", "q"), (None, None, "s")]
    for i in range(600):
        k = rng.choice((1, 5, 30))
        out.append(("".join(rng.choice(words[: 40 if i % 3 else 400]) + rng.choice(sep) for _ in range(k)), "en" if i % 4 else "de", "hot" if i % 3 == 0 else f"s{i % 23}"))
    return out + out[100:140] + [("Aa aA " * 30_000, "de", "long")]


@pytest.mark.parametrize(("block", "chunk", "span"), [(8, 16_384, 64), (2, 16, 2), (1, 7, 1)])
def test_against_plain_numbers(spark, rows, block, chunk, span):
    df = spark.createDataFrame([(i, *r, "t", 1, 2) for i, r in enumerate(rows)], SCHEMA).repartition(6)
    got = divergence.audit(df, top=20, block=block, chunk=chunk, span=span)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 20))


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces_cut_at_separators(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 7)
    for text in (b"", b"a", b"abcdefghijklmnopqrstuvw xyz", b"ab cd ef gh ij kl mn", b"   1 2 3   long" + b"g" * 50, b"x" * 21):
        assert [t for p in divergence.pieces(text) for t in p] == re.findall(rb"[a-z]+", text)


def test_shares_do_not_overflow():
    import numpy as np

    for c, d in ((0, 1), (9 * 10**14, 10**15), (3, 7), (10**15 - 2, 10**15)):
        assert divergence.shares(np.array([c], np.int64), d)[0] == 1 + 10**9 * (c + 1) // d
