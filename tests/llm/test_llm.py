"""The training-data operators against brute-force versions, on small fixtures with nulls, empties, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ripplework.llm import fingerprints, graph, html_text, jaccard, lines, mixing, packing, quality, secrets, token_files, urls
from ripplework.llm.tokens import Encoder, public_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key bigint, words string"


def make(spark, texts, source="s"):
    rows = [(i, t, "en", source if isinstance(source, str) else source[i % len(source)], len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [" ".join(word() for _ in range(rng.choice((3, 12, 60, 200)))) for _ in range(60)]
    near = []
    for t in base[:25]:
        w = t.split()
        w[rng.randrange(len(w))] = word()
        near.append(" ".join(w))
    family = base[3].split() if len(base[3].split()) > 50 else (base[3] + " " + " ".join(word() for _ in range(150))).split()
    crowd = [" ".join(w if j != k % len(family) else "edit" + str(k) for j, w in enumerate(family)) for k in range(60)]
    return [None, "", " \n\t", "one two", *base, *near, *crowd, base[0], base[0].upper(), "a b c d e " * 3000]


def brute_sets(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("block", "region"), [(4000, 512), (12, 512), (4000, 3), (12, 2)])
def test_jaccard_components(spark, texts, block, region):
    """All links of the brute force, also when every block is split by broadcast pivots and every region extended."""
    sets = [brute_sets(t) for t in texts]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(make(spark, texts), block_sets=block, region_sets=region).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("region", [512, 8])
def test_unrelated_texts_with_common_phrases(spark, region):
    """Texts that share phrases and nothing else, small texts among them, and near copies: linked as the brute force does."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    phrases = ["this very common phrase is in all of the texts", "and another one of some words more here"]
    texts = []
    for i in range(400):
        own = [word() for _ in range(rng.choice((2, 3, 20, 40)))]
        texts.append(" ".join([phrases[0], *own, phrases[1]] if i % 2 else [phrases[i % 4 // 2], *own]))
        if i % 9 == 0:
            texts.append(texts[-1] + " " + word())
    base = "q w e r t y u"
    texts += [base, *(f"{base} {x}" for x in "asdfghjkl"), base + " a b"]
    sets = [brute_sets(t) for t in texts]
    up = jaccard._Union(len(sets))
    at = defaultdict(list)
    for i, x in enumerate(sets):
        for k in x:
            at[k].append(i)
    for i, x in enumerate(sets):
        for j, n in Counter(j for k in x for j in at[k] if j < i).items():
            if 100 * n >= 75 * (len(x) + len(sets[j]) - n):
                up.join(i, j)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(make(spark, texts), region_sets=region).collect()}
    assert got == {i: up.find(i) for i in range(len(texts))}
    assert len(set(got.values())) < len(texts) - 40


def test_many_unrelated_texts_with_one_shingle_in_common(spark):
    import time

    rng = random.Random(22)
    texts = ["five words that all share " + " ".join(str(rng.randrange(10**9)) for _ in range(8)) for _ in range(10_000)]
    t = time.time()
    got = jaccard.link_components(make(spark, texts)).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got) and len(got) == 10_000
    assert time.time() - t < 60


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d e f g h"), (5, "A b c d e f g h"), (5, "x y z"), (7, None), (None, None), (8, "  \n"), (3, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("rep", F.lit(3))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs).collect())
    assert got == Counter([(None, 4, None), (5, 4, None), (5, 1, 3), (3, 1, 3), (7, 0, 7), (None, 0, None), (8, 0, 8)])
    assert jaccard.link_components(docs.limit(0)).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 3, 7, 8]


def test_join_block_matches_all_pairs():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        core = rng.integers(0, 2**63, 40, dtype=np.uint64)
        for _ in range(rng.integers(1, 12)):
            keep = core[rng.random(40) < rng.choice([0.85, 0.95, 1.0])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 8), dtype=np.uint64)])))
    u = jaccard._Union(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(np.intersect1d(a, sets[j]))
            if 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                u.join(i, j)
    assert jaccard.join_block(sets) == [u.find(i) for i in range(len(sets))]


def test_a_family_that_pivots_do_not_split_is_not_multiplied(spark):
    """Every member lies near the border of every cell, so each level would give each cell all of them."""
    rng = np.random.default_rng(8)
    core = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([core[rng.random(200) < keep], rng.integers(0, 2**63, 30, dtype=np.uint64)])) for keep in rng.choice([0.85, 0.99], 300)]
    sets += [np.append(s[1:], np.uint64(2**63 + i)) for i, s in enumerate(sets[:40])]
    names = {jaccard.fingerprint(s): i for i, s in enumerate(sets)}
    points = spark.createDataFrame([(1, f, sets[i].tobytes()) for f, i in names.items()], "block bigint, fp bigint, shingles binary")
    small, links = jaccard._split_large(points, 80)
    assert small.count() <= len(sets) * (len(sets) // 40 + 1)
    u, brute = jaccard._Union(len(sets)), jaccard._Union(len(sets))
    for r in jaccard._union([jaccard._join_blocks(small), *links]).collect():
        u.join(names[r["a"]], names[r["b"]])
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(np.intersect1d(a, sets[j]))
            if 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                brute.join(i, j)
    assert [u.find(i) for i in range(len(sets))] == [brute.find(i) for i in range(len(sets))]


def test_frequent_shingles_are_found_however_texts_are_dealt(spark):
    """A passage of every fifth text goes last in the order though no task sees it often; a text and its copies count once."""
    rng = random.Random(31)
    passage = " ".join(f"passage{k}" for k in range(60))
    texts = [" ".join([*(str(rng.randrange(10**9)) for _ in range(80)), passage if i % 5 == 0 else ""]) for i in range(1500)]
    docs = make(spark, [*texts, *["so many copies of this one text"] * 200]).repartition(200)
    hot = jaccard.frequent_shingles(docs, 32)
    assert hot.tolist() == next(jaccard.shingle_sets([passage])).tolist()
    known = jaccard.profile(docs, spark.sparkContext.broadcast(hot))
    assert jaccard._regions(jaccard._seeds(known, 32), 32).count() == 0


def test_sets_of_many_texts_are_those_of_each(texts):
    rng = random.Random(32)
    odd = ["a" * n + " b" for n in (1, 7, 8, 9, 15, 16, 17, 40)] + ["a\0 a a\x0bb\x0cc\x1cd", "日本 語 " * 9, "\ud800 x", "A B c D e F", "É é"]
    mixed = [*texts, *odd, *(" ".join(rng.choice(("ab", "abcdefgh", "abcdefghi", "abcdefghabcdefgh", "abcdefghabcdefghi")) for _ in range(30)) for _ in range(200))]
    brute = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for t in mixed for w in [(t or "").encode("utf-8", "surrogatepass").lower().split()]]
    got = list(jaccard.shingle_sets(mixed))
    assert [len(s) for s in got] == [len(s) for s in brute]
    assert len(set().union(*brute)) == len(np.unique(np.concatenate(got)))
    for a, b, x, y in zip(got, got[1:], brute, brute[1:], strict=False):
        assert len(np.intersect1d(a, b)) == len(x & y)


def test_parity_never_rules_out_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        core = np.unique(rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64))
        other = np.unique(np.concatenate([core[rng.random(len(core)) < 0.9], rng.integers(0, 2**63, 5, dtype=np.uint64)]))
        n = len(np.intersect1d(core, other))
        if 100 * n >= 75 * (len(core) + len(other) - n):
            a, b = jaccard.parity(core), jaccard.parity(other)
            assert jaccard.possible(len(core), int.from_bytes(a, "little"), 8 * len(a), len(other), int.from_bytes(b, "little"), 8 * len(b))


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert graph.components(e.limit(0)).count() == 0


def brute_base(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(win)
    hit = {j for i, x in enumerate(win) if c[x] > 1 for j in range(i, i + 5)}
    ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(ls) - len(set(ls)), len(hit)


def test_base_counts(spark, texts):
    extra = ["a\nb\na\n \n\nb", "x y z v w x y z v w x", "#$ é😀 <b>", "1 2 3 4 5 6 1 2 3 4 5 9 2 3 4 5 6"]
    docs = make(spark, texts + extra)
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r[c] for c in cols) for r in quality.base_counts(docs).select("doc_id", *cols).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts + extra)}


def test_rules_find_the_junk(spark):
    rng = random.Random(2)
    clean = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    texts = [clean() if i % 4 else re.sub(" ", " ## ", clean()) for i in range(400)]
    docs = make(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    rows = {r["id"]: r for r in quality.judge(docs, labels).collect()}
    assert all(rows[i]["kept"] == (i % 4 > 0) for i in range(400))
    assert rows[0]["rule"].startswith("1: ")
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 300
    assert quality.keep(docs, labels.limit(0)).count() == 400 and quality.keep(docs.limit(0), labels).count() == 0


def brute_statistics(t):
    """The statistics that rules are learned from, by the base counts' brute force."""
    n, chars, symbols, dup, repeat = brute_base(t)
    t = t or ""
    w, ls = re.findall(r"[^\x20\x09-\x0d]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    of = lambda p: len(re.findall(p, t))
    return {"n_words": n, "word_length": chars / max(n, 1), "symbols": symbols / max(n, 1), "dup_lines": dup / max(len(ls), 1), "repeat_words": repeat / max(n, 1), "upper": of("[A-Z]") / max(chars, 1), "digits": of("[0-9]") / max(chars, 1), "bangs": of("[!?]") / max(n, 1), "distinct_words": len(set(w)) / max(n, 1), "line_words": max(n, 1) / max(len(ls), 1)}


def brute_rules(rows, cuts):
    """Sequential covering in plain Python over (statistics, bad, held out)."""
    import math

    fits = lambda rule, x: all((x[c.statistic] > c.threshold) == c.above for c in rule)
    rules = []
    while len(rules) < quality.MAX_RULES:
        left = [r for r in rows if not any(fits(x, r[0]) for x in rules)]
        rule = ()
        while len(rule) < quality.MAX_CONDITIONS:
            grow = [(x, bad) for x, bad, held in left if not held and fits(rule, x)]
            p0 = sum(bad for _, bad in grow)
            best = (0.0, None)
            for s in quality.STATISTICS:
                for cut in cuts[s]:
                    for above in (True, False):
                        hit = [bad for x, bad in grow if (x[s] > cut) == above]
                        p = sum(hit)
                        if p >= quality.MIN_COVER:
                            g = p * (math.log2(p / len(hit)) - math.log2(p0 / len(grow)))
                            if g > best[0] + 1e-9:
                                best = (g, quality.Condition(s, above, float(cut)))
            if p0 == len(grow) or best[1] is None:
                break
            rule = (*rule, best[1])
        if not rule:
            break
        seen = []
        for k in range(1, len(rule) + 1):
            hit = [bad for x, bad, held in left if held and fits(rule[:k], x)]
            seen.append((sum(hit), len(hit)))
        k = max(range(1, len(rule) + 1), key=lambda k: ((2 * seen[k - 1][0] - seen[k - 1][1]) / max(1, seen[k - 1][1]), -k))
        p, n = seen[k - 1]
        if p < quality.MIN_COVER or p < quality.MIN_PRECISION * n:
            break
        rules.append(rule[:k])
    return rules


@pytest.fixture(scope="module")
def judged(spark):
    """Documents of several kinds of junk, some of them labelled."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    kinds = [lambda w: " ".join(w), lambda w: " ".join(w), lambda w: " ".join(x.upper() for x in w), lambda w: " # ".join(w), lambda w: "\n".join(str(rng.randrange(10**6)) + x for x in w), lambda w: " ".join(w[:5] * 8)]
    kind = [rng.randrange(len(kinds)) for _ in range(600)]
    texts = [kinds[k]([word() for _ in range(rng.randint(8, 60))]) for k in kind] + [None, "", "short", "a\nb"]
    labels = [(i, int(kind[i] < 2), 0) for i in range(0, 600, 2)] + [(1, None, 0), (None, 1, 0), (9999, 0, 0)]
    return make(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), texts, {i: q for i, q, _ in labels if i is not None and i < 600 and q is not None}


def test_verdicts_equal_brute_force(spark, judged):
    """The rules are those of a plain sequential covering, and each text's verdict follows from its own statistics."""
    docs, labels, texts, quality_of = judged
    sample = quality.labelled_sample(docs, labels)
    fold = {r["__id"]: r["f"] for r in docs.select(F.col("doc_id").alias("__id"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)).alias("f")).collect()}
    base = lambda t: (lambda n, _c, _s, _d, rep: n < 10 or 100 * rep > 20 * n)(*brute_base(t))
    rows = [(brute_statistics(texts[i]), q == 0, fold[i] == 0) for i, q in quality_of.items() if not base(texts[i])]
    assert sample.count() == len(rows)
    levels = [i / quality.BINS for i in range(1, quality.BINS)]
    got = sample.agg(*[F.percentile_approx(x, F.array(*map(F.lit, levels)), 2000).alias(x) for x in quality.STATISTICS]).first()
    cuts = {x: sorted(set(got[x])) for x in quality.STATISTICS}
    for x in quality.STATISTICS:  # the cuts are ranks of the sorted values
        v = sorted(r[0][x] for r in rows)
        assert all(any(abs(c - y) < 1e-12 for y in v) for c in cuts[x])
    rules = quality.fit(sample)
    assert rules == brute_rules(rows, cuts) and len(rules) > 1
    out = {r["id"]: r for r in quality.judge(docs, labels).collect()}
    for i, t in enumerate(texts):
        x = brute_statistics(t)
        bad = base(t)
        first = next((k for k, r in enumerate(rules) if all((x[c.statistic] > c.threshold) == c.above for c in r)), None)
        assert (out[i]["base_failed"], out[i]["kept"]) == (bad, not bad and first is None)
        assert (out[i]["rule"] or "").split(":")[0] == ("" if first is None else str(first + 1))
    kept = quality.keep(docs, labels)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if out[i]["kept"]] and kept.columns == docs.columns


#: The added rules as Python reads them.
MORE = [(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1), (r"(?:ghp|gho|ghs|github_pat|xox[abp]|sk_live)[_-][A-Za-z0-9_-]+", 20), (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30)]


def brute_spans(t):
    out = []
    base = [(p.replace("[0-9a-f]{24,}", "[0-9a-f]+"), g, least) for _, p, g, least in secrets.BASE_RULES]
    for k, (p, g, least) in enumerate(base + [(p, 0, least) for p, least in MORE]):
        out += [(m.start(), k, secrets.RULES[k][0], m.end()) for m in re.finditer(p, t or "", re.A) if len(m[g]) >= least]
    return sorted(out)


def scanned(spark, docs):
    ledger = secrets.new_ledger(spark)
    return secrets.findings(secrets.update_ledger(docs, ledger, "doc_id"), ledger).collect()


def test_secret_spans(spark):
    texts = [None, "", "é😀 password: hunter22 x", "secret:token : abcdefgh", 'API_KEY="abc" apikey = "Abc+/=_.-9"', "AKIA" + "A1" * 10 + " AKIASHORT", "deadbeef" * 4 + " x " + "0" * 23, "token=AKIA" + "Z" * 16, "passwd=abcdef" * 2, "password=abcdefgh"] * 2
    rng = random.Random(4)
    bits = ["token", "api_key", "PASSWORD", '"', "=", ":", " ", "a1b2c3d4e5f60718293a4b5c", "AKIA", "ABCDEFGH01234567", "abc", "😀", "\n", "eyJab", ".", "cd-_" * 8, "ghp_", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-"]
    texts += ["".join(rng.choices(bits, k=rng.choice((5, 30, 400)))) for _ in range(300)]
    texts += ["x" * 3 + "0123456789abcdef01234567 " * 3000 + "secret=abcdef"]  # more matches than one run holds
    got = {r["path"]: [tuple(x[c] for c in ("start", "ord", "kind", "end")) for x in r["found"]] for r in scanned(spark, make(spark, texts))}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}
    assert len(got[len(texts) - 1]) == 3001
    assert scanned(spark, make(spark, texts).limit(0)) == []


@pytest.mark.parametrize("piece", ["0123456789abcdef01234567 ", "eyJ", "secret  ", "-----BEGIN AAA ", "token=abcdef ", "AKIA"])
def test_secrets_of_long_hostile_texts(spark, piece):
    import time

    docs = make(spark, [piece * (1_000_000 // len(piece))])
    scanned(spark, docs)
    t = time.time()
    scanned(spark, docs)
    assert time.time() - t < 10


def test_ledger_is_incremental(spark):
    ledger = secrets.new_ledger(spark)
    count = lambda: secrets.read_ledger(spark, ledger).count()
    assert count() == 0
    secrets.update_ledger(make(spark, ["password=abcdefgh", "plain", "plain"]), ledger, "doc_id")
    assert count() == 2
    more = make(spark, ["password=abcdefgh", "plain", "token: zyxwvuts", None, None])
    paths = secrets.update_ledger(more, ledger, "doc_id")
    assert count() == 4
    assert sorted((r["path"], len(r["found"])) for r in secrets.findings(paths, ledger).collect()) == [(0, 1), (1, 0), (2, 1), (3, 0), (4, 0)]
    secrets.update_ledger(more, ledger, "doc_id")
    assert count() == 4
    few = secrets.RULES[:2]  # other rules have seen nothing
    assert secrets.rules_version(few) != secrets.rules_version()
    paths = secrets.update_ledger(more, ledger, "doc_id", rules=few)
    assert count() == 8
    twice = secrets.update_ledger(make(spark, ["token: zyxwvuts"] * 2).select(F.lit(None).cast("long").alias("doc_id"), "text"), ledger, "doc_id")
    assert [len(r["found"]) for r in secrets.findings(twice, ledger).collect()] == [1, 1]


def test_mix(spark, texts):
    docs = make(spark, texts, ["b", "a", None, "c"])
    rows = mixing.mix(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in enumerate(texts)}
    per = defaultdict(int)
    for r in rows:
        assert r["size"] == size[r["id"]] and 0 <= r["taken"] <= 2 * r["size"]
        per[r["source"]] += r["size"]
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    target, open_ = {}, dict(per)
    total = 1.5 * sum(per.values())
    while True:
        left = total - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[k] for k in open_) > 2 * per[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[k] for k in open_) for s in open_}
            break
        for s in over:
            target[s] = 2 * per[s]
            del open_[s]
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]])
    for s in per:
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - target[s]) <= 1
    again = mixing.mix(docs, bucket_rows=7).select("id", "taken").collect()
    assert {r["id"]: r["taken"] for r in again} == {r["id"]: r["taken"] for r in rows}
    plan = mixing.schedule(docs).collect()
    assert [r["position"] for r in plan] == sorted(r["position"] for r in plan) and all(0 <= r["position"] <= 1 for r in plan)
    assert sum(r["words"] for r in plan) == sum(r["taken"] for r in rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def brute_order(rows):
    """(position, id, copy, words, size) of every copy: passes over each source in hash order, the curve's integral inverted by bisection."""
    by, out = defaultdict(list), []
    for r in rows:
        by[r["source"]].append(r)
    for s, docs in by.items():
        curve = mixing.CURVES[sorted(by, key=lambda x: (x is None, x or "")).index(s) % len(mixing.CURVES)]
        area = lambda t, c=curve: c[0][1] * t + (c[1][1] - c[0][1]) * t * t / 2
        at, target = 0, docs[0]["target"]
        for c in range(4):
            for r in sorted(docs, key=lambda r: (hashlib.md5(str(r["id"]).encode()).hexdigest(), r["size"])):
                words = min(r["size"], round(target) - at)
                if words > 0 or r["size"] == 0 and c == 0:
                    lo, hi = 0.0, 1.0
                    for _ in range(60):
                        mid = (lo + hi) / 2
                        lo, hi = (mid, hi) if area(mid) * target < at * area(1) else (lo, mid)
                    out.append((lo, r["id"], c, max(words, 0), r["size"]))
                at += r["size"]
    return sorted(out)


def test_every_copy_has_its_place(spark, texts, tmp_path):
    docs = make(spark, texts, ["b", "a", None, "c"])
    true = brute_order(mixing.mix(docs).collect())
    assert len({c for _, _, c, _, _ in true}) > 1
    plan = [(r["id"], r["copy"], r["words"], r["position"]) for r in mixing.schedule(docs, bucket_rows=7).collect()]
    assert sorted(x[:3] for x in plan) == sorted((i, c, w) for _, i, c, w, n in true if n)
    place = {(i, c): t for t, i, c, _, _ in true}
    assert all(t == pytest.approx(place[i, c], abs=1e-6) for i, c, _, t in plan)
    out = [r["doc_id"] for r in mixing.mixed_documents(docs).collect()]
    kept = [(t, i) for t, i, _, w, n in true if 2 * w >= n]
    assert sorted(out) == sorted(i for _, i in kept)
    words = [i for i in out if texts[i] and texts[i].strip()]
    assert words == [i for t, i in kept if texts[i] and texts[i].strip()]
    make(spark, [*texts, "", ""], "ab").union(make(spark, ["", "x y"], "ab")).write.parquet(f"{tmp_path}/documents.parquet")
    order, sums = mixing.op7_training_order(spark, str(tmp_path)).collect(), mixing.op7_mixing(spark, str(tmp_path)).collect()
    assert len(sums) == len(texts) + 4 and sum(r["words"] for r in order) == sum(r["taken"] for r in sums)


def test_packing_round_trip(spark, texts):
    texts = [*texts, *MARKED]
    docs = make(spark, texts)
    path = public_path("byte_bpe_50k.json")
    enc = Tokenizer.from_file(path)  # never the encoder's own
    rows = packing.pack(docs, path, group=4096).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids, at = [*enc.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(docs.limit(0), path).count() == 0


def test_little_padding_whatever_the_length():
    for size in (5, 37, 700, 1500):
        rows = [(i, b"\x01\0\0\0" * size) for i in range(200_000 // size)]
        out = list(packing.pack_rows(iter(rows), 0))
        assert sum(r[2] for r in out) == size * len(rows)
        assert len({r[5] for r in out}) * 1024 <= 1.03 * size * len(rows) + 1024


def test_packing_rows_with_equal_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id bigint, text string")
    rows = packing.pack(docs, public_path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["length"]) for r in rows) == [(0, 0, 2), (1, 0, 3), (1, 0, 3), (2, 0, 1)]


def test_differencing():
    assert sorted(sum(x) for x in ([[8, 7, 6, 5, 4][i] for i in w] for w in packing.differencing([8, 7, 6, 5, 4], 2))) == [14, 16]
    rng = random.Random(1)
    sizes = [rng.randint(1, 256) for _ in range(500)]
    w = packing.windows(sizes)
    assert sorted(i for x in w for i in x) == list(range(500)) and all(sum(sizes[i] for i in x) <= 1024 for x in w)
    assert len(w) <= -(-sum(sizes) // 1024) + 1


#: Added tokens, glued and spaced, in either case, cut off and folded.
MARKED = ["a <|endoftext|> b", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "<|startoftext|><|endoftext|>" * 3, "a <| b |> c <||endoftext|>", " <|endoftext|>  it's"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_tokenizer(name):
    e, fresh = Encoder(public_path(name)), Tokenizer.from_file(public_path(name))
    assert not e.whole

    def want(some):
        return [np.array(x.ids, "<u4").tobytes() for x in fresh.encode_batch(some, add_special_tokens=False)]

    texts = ["a  b", "x\n \ny", " lead", "tr ", "It's don't, 'S <|endoftext|> é́ ́x", "A  b", "", "\n\n a  ", "Ünder STRASSE ß İI ΑΣ ª²", "$$$ a$$$ b'' c's 12,3 4th", "日本 語, word.", *MARKED]
    assert e.encode_all(texts) == want(texts) == e.encode_all(texts) and e.encode_all([None]) == [b""]
    r = random.Random(1)  # white space of every kind, marks that compose, letters whose lower case depends on the place
    parts = [*"aBéÉßKΣςİI ª µ ÿ 中!'9\x00", "T\u0308", "\u0307", "'s", "  ", "<|endoftext|>", "<|", *map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x2003, 0x200B, 0x3000, 0x212A, 0x1F600))]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(20_000)] + ["x" * 5000 + " y", "ab!" * 900]
    assert [x for i in range(0, len(texts), 300) for x in e.encode_all(texts[i : i + 300])] == want(texts)


def test_a_strange_vocabulary_is_encoded_whole(tmp_path):
    import json

    raw = json.load(open(public_path("byte_bpe_50k.json")))
    raw["pre_tokenizer"]["add_prefix_space"] = True
    raw["normalizer"] = {"type": "Replace", "pattern": {"String": " a"}, "content": "a"}
    (tmp_path / "odd.json").write_text(json.dumps(raw))
    e, fresh = Encoder(f"{tmp_path}/odd.json"), Tokenizer.from_file(f"{tmp_path}/odd.json")
    texts = ["b a c", " a a", ""]
    assert e.encode_all(texts) == [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_token_files_round_trip(spark, texts):
    path = public_path("word_bpe_49k.json")
    texts, enc = [*texts, *MARKED], Tokenizer.from_file(path)
    rows = sorted(token_files.read(token_files.write(make(spark, texts), path, file_ids=500)).collect(), key=lambda r: r["doc_id"])
    at = 0
    for i, (t, r) in enumerate(zip(texts, rows, strict=True)):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read(token_files.write(make(spark, texts).limit(0), path)).count() == 0


def test_blocks():
    rng = np.random.default_rng(0)
    for ids in (np.array([7], "<u4"), np.full(900, 3, "<u4"), rng.integers(0, 49408, 5000).astype("<u4"), np.r_[rng.integers(5, 9, 3000), [2**32 - 1]].astype("<u4")):
        raw = token_files.encode_file(ids, 512)
        assert (token_files.decode_file(raw) == ids).all() and (token_files.decode_file(raw, 600, 1200) == ids[600:1200]).all()


def test_fingerprints(spark, texts):
    docs = make(spark, texts)
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_with_next(docs).collect()}
    n = len(texts)
    assert len(rows) == n
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i - 1) % n] or ""
        k = len(t) // 3
        new = t[: len(t) - k] + after[:k]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        for name, a, b in (("near_edited", brute_sets(t), brute_sets(new)), ("near_next", brute_sets(t), brute_sets(after))):
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(rows[i][name] - true) <= (1e-12 if len(a | b) <= 256 else 0.15)
    assert rows[4]["fingerprint"] == rows[n - 3]["fingerprint"]
    assert fingerprints.fingerprint_with_next(docs.limit(0)).count() == 0 and fingerprints.fingerprint_with_next(docs.where("doc_id = 7")).first()["near_next"] == 1.0


def test_sketches_merge():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2), rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    whole = np.concatenate([a, b])
    assert (fingerprints.merge(fingerprints.sketch(a), fingerprints.sketch(b)) == fingerprints.sketch(whole)).all()
    assert abs(fingerprints.count(fingerprints.sketch(whole)) - 8000) < 8000 * 0.2
    assert abs(fingerprints.containment(fingerprints.sketch(b), fingerprints.sketch(whole)) - 1) < 0.2
    s = fingerprints.sketch(a)
    assert (fingerprints.from_text(fingerprints.to_text(s)) == s).all()


def test_urls(spark):
    page = '<head><link rel="canonical" href="http://a.example.org/es/7"></head>'
    rows = [(0, "https://www.example.org/es/1?x", None), (1, "http://EXAMPLE.org/en/1", None), (2, None, None), (3, "no scheme", ""), (4, "ftp://x.net", page), (5, "http://badexample.org/es/", None), (6, "http://a.example.org/es/7", None), (7, "http://x.com/de/1#a", None), (8, "https://y.com/fr/", None), (9, "http://z.com/en/", None), (4, "ftp://x.net", page)]
    got = sorted((r["id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect() if r["id"] != 4)
    assert got[0] == (0, "www.example.org", "/es/1", "example.org/es/", "block") and got[1] == (1, "example.org", "/en/1", "example.org/en/1", "block")
    assert got[2] == (2, "", "", None, "allow") and got[4] == (5, "badexample.org", "/es/", "org/", "allow")
    assert [x[4] for x in got] == ["block", "block", "allow", "allow", "allow", "block", "block", "allow", "allow"]
    four = [r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect() if r["id"] == 4]
    assert len(four) == 2 and all(r["verdict"] == "block" and r["propagated"] and r["rule"] is None for r in four)


def test_link_edges(spark):
    """Every canonical link and refresh in either attribute order, against html.parser and urljoin."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin, urlsplit

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            a = {k: v or "" for k, v in attrs}
            if tag == "link" and "canonical" in a.get("rel", "").lower().split():
                self.found.append(a.get("href", "").strip())
            if tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh" and (m := re.search(r"""[;,\s]\s*url\s*=\s*["']?([^"'\s]+)""", " " + a.get("content", ""), re.I)):
                self.found.append(m[1])

    def address(url):
        u = urlsplit(url)
        q = "&".join(x for x in u.query.split("&") if x and not re.match(r"(?i)(?:utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|ref)(?:=|$)", x))
        return "//" + re.sub(r"^(?:www|m)\.", "", u.netloc.lower()) + re.sub(r"(?:/|\.html?)$", "", u.path and urlsplit(urljoin(url, u.path)).path) + ("?" + q if q else "")

    rng = random.Random(8)
    targets = ["/de/x", "//www.Host.net/de/x", "x.html", "../up/y/", "./z?q=1", "?p=2", "http://b.com/de/./k/../l", "HTTPS://c.org/es/#t", "/go?u=http://d.com/", "mailto:a@b.c", "../../../top", "sub/page", "#t", "?utm_source=x&amp;k=v&REF=1", "/i?id=1&utm=2"]
    forms = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel='canonical'/>", "<link data-href=/no href={} rel=canonical >", '<meta http-equiv="refresh" content="0;url={}">', "<meta content='5; URL={}' http-equiv=Refresh>", '<link rel="next" href="{}">', '<meta name="url" content="0;url={}">', '<link title="a > b" rel="x canonical" href="{}">']
    rows, true = [], set()
    for i in range(150):
        url = f"http://www.p{i}.org" + rng.choice(["", "/", "/a/b", "/a/b/", "/a/b.html?x#y", "/a?utm_id=1&id=2&gclid"])
        page = "<head><!-- <link rel=canonical href=/no> --><script>'<link rel=canonical href=/no>'</script>" + "\n".join(rng.choice(forms).format(rng.choice(targets)) for _ in range(rng.randint(0, 4)))
        rows.append((url, page))
        links = Links()
        links.found = []
        links.feed(page)
        true |= {(url, address(url))} | {(address(url), address(x)) for t in links.found if t and urlsplit(x := urljoin(url, t)).netloc}
    got = {tuple(r) for r in urls.redirect_edges(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == true
    rows = [(0, "http://a.net/1", '<meta content="0;url=/x" http-equiv=refresh><link rel=canonical href="//b.net/y"><link rel=canonical href="//k.com/de/1">'), (1, "http://k.com/de/1", None)]
    assert [r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("id").collect()] == ["block", "block"]


def test_queries_tell_addresses_apart(spark):
    rows = [(0, "http://a.net/item?id=1", '<link rel=canonical href="http://k.com/de/1">'), (1, "http://a.net/item?id=2", None), (2, "https://www.a.net/item/?utm_source=x&id=1#y", None), (None, "http://a.net/item?id=1&ref=z", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("__url", F.lit("clash"))
    judged = {(0, "block"), (1, "allow"), (2, "block"), (None, "block")}  # though the target is no page of the table
    assert {(r["id"], r["verdict"]) for r in urls.judge(df).collect()} == judged
    known = df.union(spark.createDataFrame([(9, "http://k.com/de/1", None, "", "")], df.schema))
    assert {(r["id"], r["verdict"]) for r in urls.judge(known).collect()} == {*judged, (9, "block")}
    assert urls.judge(df.limit(0)).count() == 0


def test_url_twin_follows_links(spark, tmp_path):
    """The DuckDB twin on pages with chains of canonical links."""
    import duckdb

    rng = random.Random(11)
    hosts = ["a.net", "www.b.org", "m.k.com", "example.org", "x.example.org"]
    rows = []
    for i in range(300):
        url = f"http://{rng.choice(hosts)}/{rng.choice(['es', 'en', 'de', 'fr', 'q'])}/{rng.randrange(20)}{rng.choice(['', '/', '.html', '?id=1', '?ref=2'])}"
        to = rng.choice([f"http://{rng.choice(hosts)}/de/{rng.randrange(20)}", f"/q/{rng.randrange(20)}", f"//{rng.choice(hosts)}/q/{rng.randrange(20)}?id=1&amp;ref=3"])
        rows.append((i, url, f'<link rel="canonical" href="{to}">' if rng.random() < 0.3 else None))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.op4_url_filter(spark, str(tmp_path)).collect())
    assert got == sorted(c.sql(f"SELECT page_id, host, path, rule, verdict FROM ({urls.OP4_SQL})").fetchall())
    assert {x[4] for x in got} == {"allow", "block"}


def test_html():
    r = html_text.render
    assert r(None) == r("") == "" and r("a  b\n c") == "a b c"
    page = "<h1>T</h1><p>a <b>b</b><p>c<br>d<ul><li>x<li>y<ol start=3><li>q</ol></ul><table><tr><td>aa<td>b<tr><td>c<td>dddd</table><pre>x\n  y</pre><div hidden>no</div><p style='display:none'>no</p>end &amp; z<script>no</script><!-- no -->"
    assert r(page) == "T\n\na b\n\nc\nd\n\n- x\n- y\n  3. q\n\naa  b\nc   dddd\n\nx\n  y\n\nend & z"
    assert r("<div>" * 5000 + "deep" + "</div>" * 4000) == "deep" and r("<p>a<script>x") == "a" and r("a < b </nope> c") == "a < b c"


def test_html_loses_no_visible_text():
    r = html_text.render
    assert r("<head><title>T</title><p>text<p>more") == "text\n\nmore" and r("<html><head><meta charset=x>bare") == "bare"
    assert r("<head><style>no</style><noscript><img></noscript>\n</head><body>yes") == "yes"
    assert r('<p title="the hidden river">a<p class="card hidden large">b<p data-style="display:none">c<p aria-hidden=true>d') == "a\n\nb\n\nc\n\nd"
    assert r("a<p hidden>no</p><p HIDDEN=''>no</p><p style='color:red; DISPLAY : none !important'>no</p><p style='display:none;display:block'>b") == "a\n\nb"
    assert r("x <svg><defs><text>no</text></defs><title>no</title><text>A</text><path/><text>B</text></svg> <math><mi>a</mi><mo>+</mo></math>") == "x\nA\nB\na+"
    assert r("pick <select><option>a<option selected>b</select> end <select><option disabled>c<option>d</select>") == "pick b end d"
    assert r("<select multiple><option>a<option>b</select>c") == "a\nb\nc" and r("<ol data-start=7><li>q</ol>") == "1. q"


def test_html_visibility_and_spans():
    r = html_text.render
    assert r("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>") == "r  1\n   2"
    assert r("<table><tr><th colspan=2>head line long<th>z<tr><td>a<td>b<td>c</table>") == "head line long  z\na  b  c"
    assert r("a<br><br>b") == "a\n\nb" and r("<p title=it's>a<p b=\"x>y\">c") == "a\n\nc"
    assert r("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</div>x") == "yes\n\nx"
    sheet = "<style>/* p{display:none} */ .x{display:none} p#q , b.z{visibility:hidden} @media print{p{display:none}} i{display:none} i.y{display:inline}</style>"
    assert r(sheet + "<p class='a x'>no<p id=q>no<b style='visibility:visible'>yes</b><p>t<b class=z>no</b><i>no</i><i class=y>u</i>") == "yes\n\ntu"
    assert r("<dialog>no</dialog><dialog open>a</dialog>") == "a" and r("<p hidden style='display:block'>a") == "a"
    assert r("<table>" * 30 + "<tr><td>a<td>b" + "</table>" * 30).split() == ["a", "b"]


@pytest.mark.parametrize("page", ["<a ", "<a x='", '<a x="y ', "<div><b>", "<!--", "<script>", "<ul><li>x", "<", "<td rowspan=9 colspan=9>x", "<tr><td rowspan=60000>x", "<table><tr><td>", "</p>", "&amp", "<style>.a{display:none}</style><p class=a>"])
def test_html_of_long_hostile_pages(page):
    import time

    some = "<i><table>" + page * (500_000 // len(page)) + "</i></div></p>" * 1000
    t = time.time()
    html_text.render(some)
    assert time.time() - t < 8


def brute_page(rng, depth=0):
    """A random page as (html, blocks of visible words): blocks are what a margin or a line parts."""
    out, lines = [], [[]]
    for _ in range(rng.randint(1, 4)):
        word = "w" + str(rng.randrange(1000))
        kind = rng.choice(["text", "inline", "p", "div", "hidden", "invisible", "comment", "script", "br", "entity"]) if depth < 4 else "text"
        inner, blocks = brute_page(rng, depth + 1) if kind in ("inline", "div", "hidden", "invisible") else ("", [[]])
        if kind == "text":
            out.append(f" {word} ")
            lines[-1].append(word)
        elif kind == "entity":
            out.append(f" {word}&amp;&#65; ")
            lines[-1].append(word + "&A")
        elif kind == "br":
            out.append("<br>")
            lines.append([])
        elif kind == "p":
            out.append(f"<p>{word}" + rng.choice(["</p>", "<p></p>"]))
            lines += [[word], []]
        elif kind == "comment":
            out.append(f"<!-- {word} > -->")
        elif kind == "script":
            out.append(f"<script>if (a < b) '{word}'</script>")
        elif kind == "inline":
            tag = rng.choice(["b", "span", "em"])
            out.append(f"<{tag} title='a > b'>{inner}</{tag}>")
            lines[-1] += blocks[0]
            lines += blocks[1:]
        elif kind == "div":
            out.append(f"<div>{inner}</div>")
            lines += [*blocks, []]
        elif kind == "hidden":
            out.append(f"<div {rng.choice(['hidden', 'style=display:none', 'class=gone'])}>{inner}</div>")
        else:
            out.append(f"<span style='visibility:hidden'>{re.sub('<(?:p|div)', '<span', inner).replace('</p>', '</span>').replace('</div>', '</span>')}</span>")
    return "".join(out), lines


def test_html_equals_a_known_tree(spark):
    """Random pages rendered beside the tree they were written from: every visible word, in order, on its own line."""
    rng = random.Random(12)
    pages, true = [], []
    while len(pages) < 400:
        page, blocks = brute_page(rng)
        if "visibility" in page:
            continue  # line breaks inside are the layout's own matter; test_html_visibility_and_spans has them
        pages.append("<style>.gone{display:none}</style>" + page)
        true.append([" ".join(b) for b in blocks if b])
    rows = [(i // 2, p, "x", "y") for i, p in enumerate(pages)] + [(None, None, "x", "y"), (None, "", "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, id string")
    got = html_text.extract(df).collect()
    assert Counter((r["page_id"], "\n".join(x for x in r["text"].split("\n") if x)) for r in got) == Counter([(i // 2, "\n".join(x)) for i, x in enumerate(true)] + [(None, "")] * 2)
    assert html_text.extract(df.limit(0)).count() == 0


def test_line_dedup(spark):
    rng = random.Random(3)
    own = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    texts = [f"{own()}\nCopyright {2000 + i} by the authors of page {i * 7}\n{own()}\n\nok" for i in range(12)] + [None, "", "Copyright 1 by the authors"]
    docs = make(spark, texts)
    out = {r["doc_id"]: r["text"] for r in lines.drop_recurring(docs).collect()}
    assert out[0] == texts[0] and all(out[i] == "\n".join(x for x in texts[i].split("\n") if "Copyright" not in x and x != "ok") for i in range(1, 12))
    assert out[12] is None and out[13] == "" and out[14] == texts[14]
    templates, _ = lines.recurring(docs)
    assert sorted(r["pattern"] for r in templates.collect()) == ["Copyright <*> by the authors of page <*>", "ok"]
    assert lines.drop_recurring(docs.limit(0)).count() == 0 and lines.drop_recurring(docs, min_docs=13).where("__n_dropped > 0").count() == 0


def test_long_repeats_go_from_two_documents_on(spark):
    rng = random.Random(4)
    own = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage, line, short = own(60), own(10), own(9)
    texts = [f"{own(12)}\n{passage} {i}\n{line if i < 2 else own(10)}\n{short}\n{own(12)}" for i in range(3)]
    out = {r["doc_id"]: r["text"].split("\n") for r in lines.drop_recurring(make(spark, texts)).collect()}
    cut = [t.split("\n") for t in texts]
    assert [out[i] for i in range(3)] == [cut[0], [cut[1][0], *cut[1][3:]], [cut[2][0], *cut[2][2:]]]
    templates, _ = lines.recurring(make(spark, texts))
    assert sorted((r["pattern"], r["docs"]) for r in templates.collect()) == sorted([(f"{passage} <*>", 3), (line, 2)])
    assert lines.drop_recurring(make(spark, texts), exact_docs=4).where("__n_dropped > 0").count() == 0


def test_two_templates_in_one_leaf(spark):
    """Digit-free templates of one token count and prefix, each variant in one document, among unrelated lines."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    one = [f"written by {word()} for the readers of our page" for _ in range(10)]
    two = [f"written by {word()} on behalf of all good people" for _ in range(9)]
    few = [f"written by {word()} and never once seen again here" for _ in range(7)]
    noise = [" ".join(["written", "by", *(word() for _ in range(7))]) for _ in range(40)]
    texts = [*one, *two, *few, *noise]
    out = {r["doc_id"]: r["__n_dropped"] for r in lines.drop_recurring(make(spark, texts)).collect()}
    assert sorted(i for i in out if out[i]) == [*range(1, 10), *range(11, 19)]
    templates, _ = lines.recurring(make(spark, texts))
    assert sorted(r["docs"] for r in templates.collect()) == [9, 10]


def brute_line_dedup(rows, depth=2, similar=0.7, min_docs=8, long_tokens=10, exact_docs=2):
    """Positions that go from each (id, text), by the module's description, leaf by leaf in plain Python."""
    import xxhash

    key = lambda t: xxhash.xxh64_intdigest(t, 42) - (xxhash.xxh64_intdigest(t, 42) >> 63 << 64)  # noqa: E731  Spark's own
    docs = sorted({((i is not None, i or 0), key(t), t) for i, t in rows if t is not None})
    leaves = defaultdict(lambda: defaultdict(set))
    for d, (_, _, t) in enumerate(docs):
        for pos, line in enumerate(t.split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09-\x0d]+", line)]
            if w and set(w) != {"<*>"}:
                leaves[len(w), *w[:depth]][tuple(w)].add((d, pos))
    gone = defaultdict(set)

    def drop(places):
        for d, pos in sorted(places)[1:]:
            gone[d].add(pos)

    same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True))
    for forms in leaves.values():
        n_docs = {f: len({d for d, _ in at}) for f, at in forms.items()}
        recurring = set()
        if len({d for at in forms.values() for d, _ in at}) >= min_docs:
            leaders, pool, tried = [], dict(n_docs), set()
            n = len(next(iter(forms)))
            k, m = int(n * (1 - similar) + 1e-6) + 1, max(n - depth, 0)
            runs = lambda f: [(j, f[depth + j * m // k : depth + (j + 1) * m // k]) for j in range(k)]  # noqa: E731, B023
            while True:
                count, held = Counter(r for f in pool for r in runs(f)), Counter()
                for f in pool:
                    for r in runs(f):
                        held[r] += n_docs[f]
                shared = {f: [r for r in runs(f) if count[r] > 1] for f in pool}
                pool = {f: n_docs[f] for f in pool if shared[f]}
                able = [f for f in pool if f not in tried and n_docs[f] + sum(held[r] - n_docs[f] for r in shared[f]) >= min_docs]
                if not able:
                    break
                top = max(able, key=lambda f: (max(held[r] for r in shared[f]), n_docs[f], key(" ".join(f))))
                tried.add(top)
                like = [f for f in pool if same(f, top) >= similar * n]
                if sum(n_docs[f] for f in like) >= min_docs:
                    leaders.append(top)
                    pool = {f: pool[f] for f in pool if f not in like}
            groups = defaultdict(list)
            for f in forms:
                near = [(same(f, x), -i) for i, x in enumerate(leaders) if same(f, x) >= similar * n]
                groups[leaders[-max(near)[1]] if near else f].append(f)
            for some in groups.values():
                places = {p for f in some for p in forms[f]}
                if len({d for d, _ in places}) >= min_docs:
                    recurring |= set(some)
                    drop(places)
        for f, at in forms.items():
            if f not in recurring and len(f) >= long_tokens and n_docs[f] >= exact_docs:
                drop(at)
    return {(i if has else None, t): sorted(gone[d]) for d, ((has, i), _, t) in enumerate(docs)}


def test_lines_equal_a_plain_miner(spark):
    """Random lines of few words: many templates a leaf, ties, repeats, short lines, null and equal ids."""
    for seed in range(3):
        rng = random.Random(seed)
        words = ["a", "b", "c", "d7", "e", "f"]
        line = lambda: " ".join(rng.choices(words, k=rng.choice((1, 1, 2, 3, 6, 10, 12)), weights=(20, 8, 3, 4, 2, 1)))  # noqa: E731, B023
        texts = ["\n".join(line() for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["Read more\n" + line() for _ in range(9)]
        rows = [(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(1, texts[3]), (None, texts[0]), (99, None), (98, ""), (97, " \n12 3\n"), (96, "12 3")]
        true = brute_line_dedup(rows)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = lines.drop_recurring(docs).collect()
        cut = {k: "\n".join(x for j, x in enumerate(k[1].split("\n")) if j not in set(v)) for k, v in true.items()}
        assert sum(map(len, true.values())) > 40
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, None if t is None else cut[i, t]) for i, t in rows)
        assert sum(r["__n_dropped"] for r in got) == sum(len(true[i, t]) for i, t in rows if t is not None)


def test_short_lines_and_null_ids(spark):
    rng = random.Random(7)
    own = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    texts = [f"{own()}\nRead more\n{own()}\n{i}" for i in range(20)]
    rows = [(None if i < 10 else i, t) for i, t in enumerate(texts)]
    out = lines.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum("Read more" in r["text"] for r in out) == 1 and all(r["text"].split("\n")[-1].isdigit() for r in out)
    assert sum(r["__n_dropped"] for r in out if r["doc_id"] is None) == 9  # the first of all has a null id


def test_null_and_equal_ids(spark):
    """Token files, fingerprints and mixing with null and equal ids, ties and repeated rows."""
    rows = [(None, "b c", "en", "s", 3), (1, "d e f", "en", "s", 5), (1, "a", "en", None, 1), (1, "a", "en", None, 1), (2, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("start", F.lit(1)).withColumn("key", F.lit("x")).withColumn("id", F.lit(9))
    files = token_files.read(token_files.write(docs, public_path("word_bpe_49k.json"))).orderBy("start").collect()
    assert [r["doc_id"] for r in files] == [None, 1, 1, 1, 2] and [r["start"] for r in files] == list(np.cumsum([0] + [r["n_tokens"] for r in files[:-1]]))
    assert sorted(r["n_tokens"] for r in files) == [1, 2, 2, 3, 4]
    prints = fingerprints.fingerprint_with_next(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in prints) == Counter((i, len(t or "")) for i, t, *_ in rows)
    mix = mixing.mix(docs).collect()
    assert Counter((r["id"], r["size"]) for r in mix) == Counter({(None, 2): 1, (1, 3): 1, (1, 1): 2, (2, 0): 1})
    assert mixing.schedule(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_pipeline_stages_equal_brute_force(spark, judged, tmp_path):
    """Each stage beside a plain version of it, on what the stage before kept."""
    import corpus_pipeline

    _, labels, texts, _ = judged
    texts, rng = [*texts[:160], *texts[-4:]], random.Random(31)
    passage = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    texts = [t if t is None else t + "\n" + passage if i % 50 == 0 else t for i, t in enumerate(texts)] + [texts[0], texts[1], None]
    texts += [f"{t} once {'more' * i}" for i, t in enumerate(texts[1:40]) if t and "\n" not in t and len(t.split()) > 30]  # near copies
    make(spark, texts, ["a", None, "b"]).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before.collect(), now.collect())
        assert name == "packed_sequences" or tuple(now.columns) == corpus_pipeline.COLUMNS
    was, left = kept["quality_rules"]
    verdict = {r["id"] for r in quality.judge(spark.createDataFrame(was, DOCS.split(", id")[0]), labels).where("kept").collect()}
    assert {r["doc_id"] for r in left} == verdict
    was, left = kept["line_dedup"]
    gone = brute_line_dedup([(r["doc_id"], r["text"]) for r in was])
    true = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in set(v)) for (i, t), v in gone.items()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in left} == {i: (t, len(t)) for i, t in true.items() if t.strip() or not gone[i, next(r["text"] for r in was if r["doc_id"] == i)]}
    assert sum(passage in r["text"] for r in left) == 1
    was, left = kept["near_duplicates"]
    sets = {r["doc_id"]: brute_sets(r["text"]) for r in was}
    least = {i: i for i in sets}
    for i in sorted(sets):  # every link joins two groups under the least id of both
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = {k: low if v == high else v for k, v in least.items()}
    assert {r["doc_id"] for r in left} == {i for i, v in least.items() if i == v} and len(left) < len(was)
    was, left = kept["source_mix"]
    rows = spark.createDataFrame(was, DOCS.split(", id")[0])
    order = [i for _, i, _, words, n in brute_order(mixing.mix(rows).collect()) if 2 * words >= n]
    assert Counter(r["doc_id"] for r in left) == Counter(order)
    was, left = kept["packed_sequences"]
    fresh, ids = Tokenizer.from_file(public_path("byte_bpe_50k.json")), Counter()
    for r in was:
        ids[r["doc_id"]] += len(fresh.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in left:
        got[r["doc_id"]] += r["length"]
    assert got == ids
    empty = {n: spark.createDataFrame([], x) for n, x in (("documents", DOCS.split(", id")[0]), ("labels", "doc_id long, quality int, toxic int"))}
    for n, x in empty.items():
        x.write.parquet(f"{tmp_path}/none/{n}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    own = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    texts = [own(60) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", "short", None]
    docs = make(spark, texts, ["a", "b"]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept.count() == 42
    once = corpus_pipeline.near_duplicates(spark, corpus_pipeline.line_dedup(spark, kept, str(tmp_path)), str(tmp_path))
    assert sorted(r["doc_id"] for r in once.collect()) == list(range(40)) and once.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 40 * 40 < out.select(F.sum("length")).first()[0]
