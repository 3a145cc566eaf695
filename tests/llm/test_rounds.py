"""Line dedup: rounds of jobs do not grow with the templates of a leaf, and find the leaders of one at a time."""

import random

from ripplework.llm import lines


def test_rounds_of_one_leaf(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    ends = [" ".join(word() for _ in range(6)) for _ in range(10)]
    rows = [(i, f"written by {word()} {ends[i % 10]}") for i in range(90)]
    names, real = [], lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, name: names.append(name) or real(df, name))
    out = lines.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["doc_id"] for r in out if r["__n_dropped"]) == list(range(10, 90))
    assert names.count("lead") <= 3


def test_leaders_tried_together_are_those_tried_in_turn(spark):
    """Forms of few words, so that what leaders may take meets and overlaps; the order of leaders counts too."""
    rng = random.Random(9)
    forms = {" ".join(["a", "b", *rng.choices("cdefg", k=8)]): rng.randint(1, 3) for _ in range(120)}
    rows = [(1, i, n, m) for i, (m, n) in enumerate(forms.items())]
    df = spark.createDataFrame(rows, "leaf bigint, form bigint, docs bigint, masked string")
    got = []
    for tried in (1, 32):
        found = lines.leaders(df, min_docs=6, tried=tried).collect()
        got.append([r["leader"] for r in sorted(found, key=lambda r: (r["held"], r["led"], r["leader"]), reverse=True)])
    agree = lambda x, y: sum(p == q for p, q in zip(x.split(), y.split(), strict=True)) >= 7
    runs = lambda m: {(j, tuple(m.split()[2 + j * 2 : 4 + j * 2])) for j in range(4)}
    pool, tried, want = {h: (m, n) for _, h, n, m in rows}, set(), []
    while True:
        held, count = {}, {}
        for m, n in pool.values():
            for r in runs(m):
                held[r], count[r] = held.get(r, 0) + n, count.get(r, 0) + 1
        shared = {h: [r for r in runs(m) if count[r] > 1] for h, (m, _) in pool.items()}
        pool = {h: x for h, x in pool.items() if shared[h]}
        able = [h for h, (_, n) in pool.items() if h not in tried and n + sum(held[r] - n for r in shared[h]) >= 6]
        if not able:
            break
        top = max(able, key=lambda h: (max(held[r] for r in shared[h]), pool[h][1], h))
        tried.add(top)
        like = [h for h in pool if agree(pool[h][0], pool[top][0])]
        if sum(pool[h][1] for h in like) >= 6:
            want.append(top)
            pool = {h: x for h, x in pool.items() if h not in like}
    assert len(want) > 3 and got[0] == got[1] == want
