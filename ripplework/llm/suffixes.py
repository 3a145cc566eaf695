"""Removal of repeated substrings by prefix-free parsing.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same text or another one.

Parsing. A window of 16 bytes whose rolling hash is 0 modulo length / 8 is a trigger; triggers cut a text into phrases,
each from one trigger to the end of the next, so that equal text is cut alike wherever it stands. A string that starts d
bytes before its first trigger is the last d bytes of a phrase, followed by a suffix of the parse: its place in the order
of all suffixes of the corpus is (place of that phrase suffix among those of the dictionary, place of the parse suffix).

1. Texts are dealt into blocks of about 2 MB, equal texts of a block once with a weight; blocks are written.
2. Every parse position sends 32 bits of the hash of the length / 2 bytes at its trigger to a bucket and hears whether they
   stand twice. Those that do not start no repeated string, which leaves the repetitive part of the corpus. A string with no
   trigger in its first half lies inside one long phrase; it sends the hash of itself.
3. The positions left send their contexts (phrase before the trigger, text after it) to the bucket of the half string at
   the trigger, equal contexts of a block once with a weight. A bucket sorts its dictionary by reversed phrases with common
   suffix lengths, its parse suffixes with common prefix lengths, and combines both to corpus order for each d: strings of
   equal place and weight 2 or more repeat. Strings inside long phrases are compared by 128-bit digest.
4. Each block hears which of its strings repeat and removes what they cover.

Skew: a half string that stands more than `hot` times (a phrase of millions of texts) would fill a bucket with different
contexts, so the strings over its positions are compared one by one by digest; a bucket hears of each of them once for each
block. Nothing is sampled or dropped. Buckets grow in number with the input, a task holds one block or one bucket.

Defined results: null text is empty; texts shorter than `length` lose nothing; matches never cross texts; strings are
compared on the input, not on what is left; equal rows and equal or null ids are rows of their own, and equal texts of at
least `length` bytes all lose everything; an empty table gives an empty result. Half strings are told apart by
a 64-bit hash, what stands before and after them by its bytes, strings inside long phrases by 128-bit digests.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import mix, release, slices
from ripplework.session import materialize, table

LENGTH = 200
TRIGGER = 16
BLOCK = 2 << 20
#: Occurrences of a half string beyond which its strings are compared one by one.
HOT = 50_000
#: Half strings, and contexts, of a bucket on average.
KEYS, CONTEXTS = 1_000_000, 100_000
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_DEEP = np.uint64(0xA0761D6478BD642F)
SHIPPED = "kind int, bucket int, block bigint, seg int, load binary"


@cache
def _powers(family: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, powers of the multiplier and of its inverse modulo 2^64."""
    m = _MULTIPLIERS[family]
    grow = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))])
    return np.random.default_rng(11 + family).integers(0, 2**64, 256, dtype=np.uint64), grow(m), grow(pow(m, -1, 2**64))


class Rolling:
    """64-bit hashes of any substrings of some bytes, from prefix sums."""

    def __init__(self, b: np.ndarray, family: int, most: int):
        values, powers, self.back = _powers(family, most)
        terms = values[b]
        terms *= powers[: len(b)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


class Segment:
    """The parse positions of the strings that start in [base, base + block) of a block's bytes.

    t, lo, hi: triggers, and first and last start of the strings whose first trigger each is, at most half before it.
    deep: starts of the strings with no trigger in their first half. All are offsets from base.
    """

    def __init__(self, b: np.ndarray, ends: np.ndarray, base: int, length: int, block: int):
        self.half = length // 2
        self.near = b[base : base + block + 2 * length]
        self.length = length
        n, w = len(self.near), min(TRIGGER, length // 4)
        self.one = Rolling(self.near, 0, block + 2 * length)
        at = np.arange(max(0, n - w + 1))
        hit = at[self.one(at, at + w) % np.uint64(max(2, length // 8)) == 0]
        first = int(np.searchsorted(ends, base, "right"))
        stops = np.minimum(ends[first : int(np.searchsorted(ends, base + n, "left")) + 1] - base, n)
        text = np.searchsorted(stops, hit, "right")
        hit = hit[hit + w <= stops[np.minimum(text, len(stops) - 1)]] if len(stops) else hit[:0]
        pos = np.concatenate([stops, hit])
        by = np.argsort(pos, kind="stable")  # the end of a text before a trigger of the next
        pos, stop = pos[by], (np.arange(len(pos)) < len(stops))[by]
        before = np.concatenate([[0], np.where(stop, pos, pos + 1)[:-1]]) if len(pos) else pos
        text = np.cumsum(stop) - stop
        last = np.minimum(stops[text] if len(stops) else pos, n) - length
        last = np.minimum(last, block - 1)
        lo, hi = np.maximum(before, pos - self.half), np.minimum(pos, last)
        good = ~stop & (lo <= hi)
        self.t, self.lo, self.hi = pos[good], lo[good], hi[good]
        self.stop = stops[text[good]] if len(stops) else pos[good]
        count = np.maximum(np.minimum(pos - self.half - 1, last) - before + 1, 0)
        self.deep = np.repeat(before - np.cumsum(count) + count, count) + np.arange(count.sum())
        self.text, self.deep_text = first + text[good], first + np.repeat(text, count)
        self.keys = np.concatenate([self.one(self.t, self.t + self.half), mix(self.one(self.deep, self.deep + length) ^ _DEEP)])

    def filter(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct 32-bit keys under their bucket, which of them each position has, first of each bucket)."""
        key = ((self.keys % np.uint64(buckets)) << np.uint64(32)) | (self.keys >> np.uint64(32))
        u, which = np.unique(key, return_inverse=True)
        return u, which, np.searchsorted(u, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


def _segments(n: int, block: int) -> range:
    return range(0, max(n, 1), block)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(load: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(load)
    sizes = np.frombuffer(raw, "<u4", len(types) + 1)[1:]
    at, out = 4 * (len(types) + 1), []
    for kind, size in zip(types, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _rows(rows: list[tuple], names: str, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names.split())


def blocks(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """(block, ids, which, ends, size, load): texts of about `block` bytes, equal ones once; which text each id has."""
    rows = docs.select(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))

    def run(batches):
        texts, ids, which, size = {}, [], [], 0

        def out():
            b = b"".join(texts)
            return _rows([(ids, which, np.cumsum([len(t) for t in texts]), len(b), zstandard.ZstdCompressor(level=6).compress(b))], "ids which ends size load", [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.binary()])

        for some in slices(batches):
            for i, text in some:
                if text not in texts:
                    texts[text] = len(texts)
                    size += len(text)
                ids.append(i)
                which.append(texts[text])
                if size >= block or len(ids) >= 50_000:
                    yield out()
                    texts, ids, which, size = {}, [], [], 0
        if ids:
            yield out()
        release()

    got = rows.mapInArrow(run, "ids array<bigint>, which array<int>, ends array<bigint>, size bigint, load binary")
    return got.select(F.monotonically_increasing_id().alias("block"), "*")


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's bytes, ends of its texts, and how many rows have each text."""
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["load"], max_output_size=max(1, row["size"])), np.uint8) if row["size"] else np.empty(0, np.uint8)
    return b, np.array(row["ends"], np.int64), np.bincount(np.array(row["which"], np.int64), minlength=len(row["ends"]))


def _each(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def ask(written: DataFrame, buckets: int, length: int, block: int) -> DataFrame:
    """(kind, bucket, block, seg, load): the distinct keys of each segment, by bucket, and weights other than 1."""

    def run(batches):
        for row in _each(batches):
            b, ends, weights = _block(row)
            for seg, base in enumerate(_segments(len(b), block)):
                s = Segment(b, ends, base, length, block)
                u, which, first = s.filter(buckets)
                if not len(u):
                    continue
                weight = np.bincount(which, weights[np.concatenate([s.text, s.deep_text])], len(u)).astype(np.uint32)
                number = np.bincount(which, minlength=len(u)).astype(np.uint32)
                rows = []
                for k in np.flatnonzero(np.diff(first)):
                    part = slice(first[k], first[k + 1])
                    more = np.flatnonzero(weight[part] > 1).astype(np.uint32)
                    rows.append((0, int(k), row["block"], seg, u[part].astype(np.uint32).tobytes() + np.concatenate([more, weight[part][more], number[part][more], [len(more)]]).astype(np.uint32).tobytes()))
                yield _rows(rows, "kind bucket block seg load", [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()])
        release()

    return written.select("block", "which", "ends", "size", "load").mapInArrow(run, SHIPPED)


def _by_bucket(batches):
    """Rows of each bucket of a sorted partition, together."""
    bucket, held = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if row[1] != bucket and held:
                yield bucket, held
                held = []
            bucket = row[1]
            held.append(row)
    if held:
        yield bucket, held


def answer(asked: DataFrame, hot: int) -> DataFrame:
    """(block, seg, bucket, live, hot, n): which of the keys stand twice in the corpus, and which more than `hot` times."""

    def run(batches):
        for bucket, rows in _by_bucket(batches):
            raw = [np.frombuffer(r[4], np.uint32) for r in rows]
            keys, weight, number = [], [], []
            for a in raw:
                m = int(a[-1])
                k = len(a) - 1 - 3 * m
                w = np.ones((2, k), np.int64)
                w[:, a[k : k + m]] = a[k + m : k + 2 * m], a[k + 2 * m : k + 3 * m]
                keys.append(a[:k])
                weight.append(w[0])
                number.append(w[1])
            u, which = np.unique(np.concatenate(keys), return_inverse=True)
            alive = (np.bincount(which, np.concatenate(weight)) > 1)[which]
            often = (np.bincount(which, np.concatenate(number)) > hot)[which]
            at, out = 0, []
            for r, k, c in zip(rows, keys, number, strict=True):
                part = slice(at, at + len(k))
                at += len(k)
                if alive[part].any():
                    out.append((r[2], r[3], bucket, np.packbits(alive[part]).tobytes(), np.packbits(often[part]).tobytes(), int(c[alive[part]].sum())))
            if out:
                yield _rows(out, "block seg bucket live hot n", [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()])

    return asked.mapInArrow(run, "block bigint, seg int, bucket int, live binary, hot binary, n bigint")


def _ragged(start: np.ndarray, count: np.ndarray, step: int = 1) -> np.ndarray:
    """start, start + step, ... for each pair."""
    offset = np.cumsum(count) - count
    return np.repeat(start - step * offset, count) + step * np.arange(int(count.sum()))


def contexts(joined: DataFrame, asked_buckets: int, buckets: int, length: int, block: int, places: bool) -> DataFrame:
    """What is left of the parse, as rows of three kinds: 0 contexts and 1 digests of strings, each by bucket, or, with
    `places`, 2 where in the segment they stand, which the block needs."""

    def distinct(columns: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a position of each distinct row, which row each position has, summed weights), rows ordered by the first column."""
        by = np.lexsort(columns[::-1])
        new = np.ones(len(by), bool)
        new[1:] = np.logical_or.reduce([c[by][1:] != c[by][:-1] for c in columns])
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        return by[new], which, np.bincount(which, weight).astype(np.uint32)

    def run(batches):
        for row in _each(batches):
            b, ends, weights = _block(row)
            heard = {}
            for a in row["answers"]:
                heard.setdefault(a["seg"], []).append(a)
            for seg, base in enumerate(_segments(len(b), block)):
                if seg not in heard:
                    continue
                s = Segment(b, ends, base, length, block)
                u, which, first = s.filter(asked_buckets)
                live, hot = np.zeros(len(u), bool), np.zeros(len(u), bool)
                for a in heard[seg]:
                    at, k = first[a["bucket"]], first[a["bucket"] + 1] - first[a["bucket"]]
                    live[at : at + k] = np.unpackbits(np.frombuffer(a["live"], np.uint8), count=k)
                    hot[at : at + k] = np.unpackbits(np.frombuffer(a["hot"], np.uint8), count=k)
                live, hot = live[which], hot[which]
                two = Rolling(s.near, 1, block + 2 * length)
                k = len(s.t)
                rows = []
                # contexts
                c = np.flatnonzero(live[:k] & ~hot[:k])
                t, lo, hi, end = s.t[c], s.lo[c], s.hi[c], np.minimum(s.t[c] + length, s.stop[c])
                half = two(t, t + s.half)
                where = (half % np.uint64(buckets)).astype(np.int64)
                whole = [f(lo, end) + ((t - lo) * 65_536 + (t - hi)).astype(np.uint64) * _DEEP for f in (s.one, two)]
                pick, of, weight = distinct([where, half, *whole], weights[s.text[c]])
                size_l, size_r, low = t - lo, end - t - s.half, t - hi
                for at, stop in [] if places else _runs(where[pick]):
                    p = pick[at:stop]
                    load = _pack(half[p], weight[at:stop], size_l[p].astype("<u2"), size_r[p].astype("<u2"), low[p].astype("<u2"), s.near[_ragged(t[p] - 1, size_l[p], -1)], s.near[_ragged(t[p] + s.half, size_r[p])])
                    rows.append((0, int(where[p[0]]), row["block"], seg, load))
                mine = [t, lo, hi, of, where[pick]]
                # strings one by one: those inside long phrases, and those at hot half strings
                c = np.flatnonzero(live[:k] & hot[:k])
                starts = np.concatenate([s.deep[live[k:]], _ragged(s.lo[c], s.hi[c] - s.lo[c] + 1)])
                weight = weights[np.concatenate([s.deep_text[live[k:]], np.repeat(s.text[c], s.hi[c] - s.lo[c] + 1)])]
                digest = [s.one(starts, starts + length), two(starts, starts + length)]
                where = (digest[1] % np.uint64(buckets)).astype(np.int64)
                pick, of, weight = distinct([where, *digest], weight)
                for at, stop in [] if places else _runs(where[pick]):
                    p = pick[at:stop]
                    rows.append((1, int(where[p[0]]), row["block"], seg, _pack(digest[0][p], digest[1][p], weight[at:stop])))
                mine += [starts, of, where[pick]]
                if places:
                    rows.append((2, -1, row["block"], seg, _pack(*[m.astype("<i4") for m in mine])))
                if rows:
                    yield _rows(rows, "kind bucket block seg load", [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()])
        release()

    return joined.mapInArrow(run, SHIPPED)


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if not len(sorted_values):
        return []
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_values)], strict=True))


def _sorted_with_common(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of byte strings (padded rows, their sizes), and what each has in common with the one before it.

    Strings of different groups stand apart and have -1 in common.
    """
    by = np.argsort(sizes, kind="stable")
    if rows.shape[1]:
        by = by[np.argsort(np.ascontiguousarray(rows[by]).view(f"S{rows.shape[1]}").ravel(), kind="stable")]
    if group is not None:
        by = by[np.argsort(group[by], kind="stable")]
    common = np.full(len(by), -1, np.int64)
    if len(by) > 1:
        r, z = rows[by], sizes[by]
        other = r[1:] != r[:-1]
        first = np.where(other.any(1), other.argmax(1), rows.shape[1]) if rows.shape[1] else np.zeros(len(by) - 1, np.int64)
        common[1:] = np.minimum(first, np.minimum(z[1:], z[:-1]))
        if group is not None:
            common[1:][group[by][1:] != group[by][:-1]] = -1
    return by, common


def corpus_order(half: np.ndarray, phrases: np.ndarray, size_l: np.ndarray, after: np.ndarray, size_r: np.ndarray, low: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """For each context of a bucket, which of its strings repeat: row by d, the bytes before the trigger, from `low`.

    The suffix array of the dictionary orders phrases by their reversed bytes, that of the parse orders what follows the
    triggers; common lengths of neighbours give, for each d, the class of the phrase suffix of d bytes and of the parse
    suffix to length - d bytes. Both together are the place of the string in corpus order.
    """
    n, near = len(weight), length // 2
    repeated = np.zeros((n, near + 1), bool)
    by_l, common_l = _sorted_with_common(phrases, size_l)
    by_r, common_r = _sorted_with_common(after, size_r, half)
    place_l, place_r = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(near + 1):
        has = np.flatnonzero((size_l >= d) & (low <= d))
        if not len(has):
            continue
        place_l[by_l] = np.cumsum(common_l < d)
        place_r[by_r] = np.cumsum(common_r < length - near - d)
        order = place_r[has] * (n + 1) + place_l[has]
        _, which = np.unique(order, return_inverse=True)
        repeated[has, d] = (np.bincount(which, weight[has]) > 1)[which]
    return repeated


def compare(shipped: DataFrame, length: int) -> DataFrame:
    """(kind, bucket, block, seg, load): which strings of each context, and which single strings, repeat; bits packed."""

    def run(batches):
        for bucket, rows in _by_bucket(batches):
            out = []
            mine = [r for r in rows if r[0] == 0]
            if mine:
                parts = [_unpack(r[4], "<u8", "<u4", "<u2", "<u2", "<u2", "u1", "u1") for r in mine]
                sizes = [len(p[0]) for p in parts]
                name, weight, size_l, size_r, low, flat_l, flat_r = (np.concatenate(x) for x in zip(*parts, strict=True))
                del parts

                def padded(flat, size, width):
                    m = np.zeros((len(size), width), np.uint8)
                    m[np.arange(width) < size[:, None]] = flat
                    return m

                size_l, size_r, low = (x.astype(np.int64) for x in (size_l, size_r, low))
                said = corpus_order(np.unique(name, return_inverse=True)[1], padded(flat_l, size_l, length // 2), size_l, padded(flat_r, size_r, length - length // 2), size_r, low, weight, length)
                at = 0
                for r, k in zip(mine, sizes, strict=True):
                    part = said[at : at + k]
                    at += k
                    if part.any():
                        out.append((0, bucket, r[2], r[3], _pack(np.packbits(part.ravel()))))
            mine = [r for r in rows if r[0] == 1]
            if mine:
                parts = [_unpack(r[4], "<u8", "<u8", "<u4") for r in mine]
                one, two, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
                by = np.lexsort([two, one])
                new = np.ones(len(by), bool)
                new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
                which = np.empty(len(by), np.int64)
                which[by] = np.cumsum(new) - 1
                said = (np.bincount(which, weight) > 1)[which]
                at = 0
                for r, p in zip(mine, parts, strict=True):
                    part = said[at : at + len(p[2])]
                    at += len(part)
                    if part.any():
                        out.append((1, bucket, r[2], r[3], _pack(np.packbits(part))))
            if out:
                yield _rows(out, "kind bucket block seg load", [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()])
        release()

    return shipped.mapInArrow(run, SHIPPED)


def _starts(places: bytes, said: dict, half: int) -> np.ndarray:
    """Starts of the repeated strings of a segment."""
    t, lo, hi, of, where, starts, of_one, where_one = (x.astype(np.int64) for x in _unpack(places, *["<i4"] * 8))
    found = []
    for kind, buckets in ((0, where), (1, where_one)):
        bits = np.zeros((len(buckets), half + 1) if kind == 0 else len(buckets), bool)
        for at, stop in _runs(buckets):
            load = said.get((kind, int(buckets[at])))
            if load is not None:
                got = np.unpackbits(_unpack(load, "u1")[0], count=bits[at:stop].size).astype(bool)
                bits[at:stop] = got.reshape(bits[at:stop].shape)
        if kind == 0:
            row, d = np.nonzero(bits[of]) if len(of) else (np.empty(0, np.int64),) * 2
            good = (d >= (t - hi)[row]) & (d <= (t - lo)[row])
            found.append((t[row] - d)[good])
        else:
            found.append(starts[bits[of_one]])
    return np.concatenate(found)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(id, n_bytes, kept, spans): what is left of each text, as bytes, and the spans (start, end) that were removed."""
    if not 8 <= length <= 60_000:
        raise ValueError("length must lie between 8 and 60000 bytes")
    spark = docs.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = materialize(blocks(docs, id_col, text_col, block), "blocks")
    size = written.agg(F.sum("size")).first()[0] or 0
    first = max(wide, size * 12 // length // KEYS)  # about 12 keys in the bytes of a string
    asked = ask(written, first, length, block).repartition(first, "bucket").sortWithinPartitions("bucket")
    answers = materialize(answer(asked, hot), "answers")
    left = answers.agg(F.sum("n")).first()[0] or 0
    second = max(wide, left // CONTEXTS)
    told = answers.groupBy("block").agg(F.collect_list(F.struct("seg", "bucket", "live", "hot")).alias("answers"))
    written = written.where("block is not null")  # as an inner join asks too: the plan shuffles the blocks once for all three
    joined = written.join(told, "block")
    shipped = contexts(joined, first, second, length, block, False)
    dealt = shipped.repartition(second, "bucket").sortWithinPartitions("bucket", "kind", "block", "seg")
    said = compare(dealt, length).union(contexts(joined, first, second, length, block, True))
    said = said.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "seg", "load")).alias("said"))
    half = length // 2

    def run(batches):
        for row in _each(batches):
            b, ends, _ = _block(row)
            edge = np.zeros(len(b) + 1, np.int32)
            by_seg = {}
            for s in row["said"] or []:
                by_seg.setdefault(s["seg"], {})[s["kind"], s["bucket"]] = s["load"]
            for seg, heard in by_seg.items():
                at = _starts(heard[2, -1], heard, half) + seg * block
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            texts = []
            for start, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
                cut = np.flatnonzero(np.diff(np.concatenate([[False], gone[start:end], [False]]).astype(np.int8)))
                texts.append((end - start, b[start:end][~gone[start:end]].tobytes(), [{"start": x, "end": y} for x, y in cut.reshape(-1, 2).tolist()]))
            rows, held = [], 0
            for i, w in zip(row["ids"], row["which"], strict=True):
                rows.append((i, *texts[w]))
                held += len(texts[w][1])
                if held > 4 * block:
                    yield _rows(rows, "id n_bytes kept spans", types)
                    rows, held = [], 0
            if rows:
                yield _rows(rows, "id n_bytes kept spans", types)
        release()

    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return written.join(said, "block", "left").mapInArrow(run, "id bigint, n_bytes bigint, kept binary, spans array<struct<start: bigint, end: bigint>>")


def op11_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 200 bytes by its digest; texts as hexadecimal digits, cut into stretches first so that positions are found fast.
OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n FROM d),
s AS (SELECT r, n, b, substr(h, 2 * b + 1, 2398) AS g FROM (SELECT *, unnest(range(0, n - 199, 1000)) AS b FROM n WHERE n >= 200)),
w AS (SELECT r, b + i AS p, md5(substr(g, 2 * i + 1, 400)) AS k FROM (SELECT *, unnest(range(0, least(1000, n - 199 - b))) AS i FROM s)),
m AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
i AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS run FROM m),
u AS (SELECT r, run, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY 1, 2),
v AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM u),
k AS (SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, sum(z - a) AS removed, count(*) AS spans, max(z) AS z FROM v JOIN n USING (r) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN k USING (r)
"""
