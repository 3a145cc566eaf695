"""How far the sources of a language lie apart in their words: exact divergences of all pairs of groups, by tiles.

A group is a (language, source). Its terms are runs of letters and of anything beyond ASCII, A-Z lower-cased; a language
keeps the V terms that stand in at least `min_docs` of its documents. A term's share of a group is
p = 1 + floor(10^9 * (count + 1) / (N + V)), N being the group's occurrences of kept terms; the divergence of a group from
another is the sum of floor((p - q)^2 / q) over the kept terms, in whole numbers throughout.

The kept terms are dealt into chunks by hash and numbered in them, and the groups into blocks. Each group's counts in a
chunk become one packed vector, which is replicated to the tiles (block by block) its block takes part in. A tile reads
its vectors chunk after chunk, spreads them out to shares and adds up its submatrix of pairs in both directions; a task
holds two blocks of one chunk and the sums. The chunks of a very large vocabulary are dealt into spans, whose sums are
added. Counts are added up where texts are read, so a hot group is not gathered anywhere.

Defined results: null text, language or source is the empty string; a group without terms has count 0 for every kept term;
in a language that keeps no term all divergences are 0 and there are no term rows; a language with one source has no
pairs; repeated rows and equal ids count as documents of their own; terms are told apart by their UTF-8 bytes, by which
ties are ordered too; an empty table gives an empty result. Counts must stay under 10^15.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplework.llm.common import release, slices
from ripplework.session import materialize, table

MIN_DOCS = 3
TOP = 200
#: Groups of a block, terms of a chunk (both on average), chunks of a span.
BLOCK = 8
CHUNK = 16_384
SPAN = 64
#: Entries a reader holds before it hands its counts on.
HELD = 100_000
_PIECE = 1 << 20
#: ASCII letters in lower case, all other ASCII as a space; bytes of other characters as they are.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def pieces(text: bytes):
    """The terms of a text, a list for about each million bytes."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        part = text[at:end].translate(FOLD)
        if end < len(text):  # a term goes on to the next separator
            cut = part.rfind(b" ")
            while cut < 0 and end < len(text):
                part += text[end : end + _PIECE].translate(FOLD)
                end += _PIECE
                cut = part.rfind(b" ")
            if end < len(text):
                end = end - len(part) + cut + 1
                part = part[:cut]
        yield part.split()
        at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, tf, df): occurrences, and documents with the term."""
    rows = docs.select(*[F.coalesce(c, F.lit("")) for c in (lang_col, source_col)], F.coalesce(F.col(text_col), F.lit("")).cast("binary"))

    def run(batches):
        tf, df = defaultdict(Counter), defaultdict(Counter)

        def out():
            for g, c in tf.items():
                terms = list(c)
                k = len(terms)
                yield pa.RecordBatch.from_arrays([pa.array([g[0]] * k, pa.string()), pa.array([g[1]] * k, pa.string()), pa.array(terms, pa.binary()), pa.array(c.values(), pa.int64()), pa.array([df[g][t] for t in terms], pa.int64())], ["lang", "source", "term", "tf", "df"])
            tf.clear()
            df.clear()

        for some in slices(batches):
            for lang, source, text in some:
                seen = set()
                for terms in pieces(text):
                    tf[lang, source].update(terms)
                    seen.update(terms)
                df[lang, source].update(seen)
            if sum(map(len, tf.values())) > HELD:
                yield from out()
        yield from out()
        release()

    got = rows.mapInArrow(run, "lang string, source string, term binary, tf bigint, df bigint")
    return got.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _share_sql(count: str, n: str, v: str) -> str:
    """1 + floor(10^9 * (count + 1) / (n + v)) over longs, three digits of the quotient at a time so that no product overflows."""
    d = f"({n} + {v})"
    q, r = f"(({count} + 1) div {d})", f"(({count} + 1) % {d})"
    for _ in range(3):
        q, r = f"({q} * 1000 + ({r} * 1000) div {d})", f"(({r} * 1000) % {d})"
    return f"(1 + {q})"


def shares(count: np.ndarray, d: int) -> np.ndarray:
    """The same for an array of counts, d being n + v."""
    r = count + 1
    q, r = r // d, r % d
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // d, r % d
    return q + 1


def vocabulary(counts: DataFrame, min_docs: int, chunk: int) -> DataFrame:
    """(lang, term, tf, lang_n, lang_v, chunk, at): the kept terms of each language, dealt into chunks and numbered in them."""
    kept = counts.groupBy("lang", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where(F.col("df") >= min_docs).drop("df")
    kept = materialize(kept, "kept-terms")
    langs = materialize(kept.groupBy("lang").agg(F.sum("tf").alias("lang_n"), F.count("*").alias("lang_v")), "languages")
    dealt = kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("lang_v") / chunk)).cast("int"))
    dealt = dealt.repartition("lang", "chunk")  # a language is dealt by its chunks, not sorted in one task
    return materialize(dealt.withColumn("at", F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1), "vocabulary")


def tiles(groups: DataFrame, vectors: DataFrame, chunks: DataFrame, block: int, span: int) -> DataFrame:
    """Rows (tile, chunk, vector), sorted for tile_sums: each group's vector of each chunk for each tile of its block."""
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    every = own.join(chunks, "lang", "left").withColumns({"chunk": F.coalesce("chunk", F.lit(0)), "size": F.coalesce("size", F.lit(0)), "v": F.coalesce("v", F.lit(0))})
    every = every.join(vectors, ["lang", "source", "chunk"], "left")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = every.withColumn("other", other).select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.floor(F.col("chunk") / span).cast("int").alias("span"), "chunk", "source", "block", "size", (F.col("n") + F.col("v")).alias("d"), "ats", "tfs")
    tile = ["lang", "low", "high", "span"]
    return dealt.repartition(*tile).sortWithinPartitions(*tile, "chunk", "source")


def tile_sums(batches):
    """(lang, source, item, value) of each tile, in both directions, from rows sorted by tile and chunk."""
    tile, chunk, held, sums = None, None, [], defaultdict(int)

    def add():
        """One chunk of the tile: shares of every group, then the pairs."""
        if not held:
            return
        low, high = tile[1], tile[2]
        size = held[0][2]
        p = np.empty((len(held), size), np.int64)
        for row, (_, _, _, d, at, tf) in zip(p, held, strict=True):
            if size:
                row[:] = shares(np.zeros(1, np.int64), d)
                if at is not None:
                    row[at] = shares(tf, d)
        for j, (item, block, *_) in enumerate(held):
            mine = [i for i, h in enumerate(held) if i != j and (low == high or h[1] != block)]
            for i in mine:
                off = p[i] - p[j]
                sums[held[i][0], item] += int((off * off // p[j]).sum()) if size else 0
        held.clear()

    def out():
        keys = list(sums)
        batch = pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(keys), pa.string()), pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([sums[k] for k in keys], pa.int64())], ["lang", "source", "item", "value"])
        sums.clear()
        return batch

    for b in batches:
        lang, low, high, span, at_chunk, source, block, size, d = (b.column(i).to_pylist() for i in range(9))
        ats, tfs = b.column(9), b.column(10)
        for i in range(b.num_rows):
            now = (lang[i], low[i], high[i], span[i])
            if now != tile or at_chunk[i] != chunk:
                add()
                if now != tile and sums:
                    yield out()
                tile, chunk = now, at_chunk[i]
            filled = ats[i].is_valid
            held.append((source[i], block[i], size[i], d[i], ats[i].values.to_numpy(zero_copy_only=False).copy() if filled else None, tfs[i].values.to_numpy(zero_copy_only=False).copy() if filled else None))
    add()
    if sums:
        yield out()


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for every ordered pair of sources of a language, `term` rows for
    the terms a group has more of than its language, the first `top` by what each adds."""
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    terms = vocabulary(counts, min_docs, chunk)
    kept = materialize(counts.select("lang", "source", "term", F.col("tf").alias("c")).join(terms, ["lang", "term"]), "kept-counts")
    groups = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = materialize(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")), "groups")
    sizes = terms.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("size"), F.max("lang_v").alias("v"))
    packed = F.array_sort(F.collect_list(F.struct("at", "c")))  # at most the terms of a chunk
    vectors = kept.groupBy("lang", "source", "chunk").agg(packed.alias("e")).select("lang", "source", "chunk", F.col("e.at").alias("ats"), F.col("e.c").alias("tfs"))
    pairs = tiles(groups, vectors, sizes, block, span).mapInArrow(tile_sums, "lang string, source string, item string, value bigint")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    told = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), F.expr(_share_sql("c", "n", "lang_v")).alias("p"), F.expr(_share_sql("tf", "lang_n", "lang_v")).alias("q"))
    told = told.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    told = told.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.union(told.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS tf FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, sum(tf)::HUGEINT AS n, count(*)::HUGEINT AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + l.v) AS p, 1 + (1000000000::HUGEINT * (k.tf + 1)) // (l.n + l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM s WHERE c > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""
