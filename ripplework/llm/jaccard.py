"""N-gram Jaccard join in metric space: exact, recursive, by pivots.

Jaccard distance d = 1 - |x & y| / |x | y| is a metric; two texts link when d <= r = 0.25. Equal shingle sets are one
point. Points meet in three steps, each of which loses no link:

1. Seeds. All shingles have one global order: by hash, but frequent ones last. Any such order is right; which shingles are
   frequent is counted in one of 16 texts, so that the region of a seed does not grow with the table. Linked sets share one
   of their first n - ceil(0.75 n) + 1 shingles, so they meet in that seed's region. Unrelated texts are all at distance 1, where Voronoi
   cells cannot tell them apart; seeds stand in for pivots there. In a region of up to `region_sets` points, parity bitmaps
   (one bit for each class of hashes, flipped by each member) bound the symmetric difference from below and rule out most
   pairs. Of a larger one a sample of points is compared: if most may be linked to one of them, the region goes on as it
   is; if not, its points meet again by this seed and a later one, for linked sets share j of their first
   n - ceil(0.75 n) + j shingles. So neither a family of copies nor a common phrase is compared pair by pair.
2. Regions that share a possible link are one block. Blocks are joined exactly on whole shingle sets: two pivots, the
   Voronoi cells around them, points within 2r of the border in both cells, cells joined recursively. Sorting by the
   distance to a pivot, a gap over r splits a cell (no pair across it can link); points within r of the pivot are
   linked to it, and only those that could reach a point outside go on. So a tight group of n copies takes n distances.
   Shingles that two sets of a block share have a bit each, so that a distance is a count of bits.
3. A block too large for a task, in points or in bytes, is split the same way across tasks: pivots are broadcast, those of
   so many blocks at once as fit a fixed size, each point finds its cells where it is, and what is left of a cell too
   large once more goes down a level.

Defined results: null or wordless text has no shingles, links with nothing and is its own component; a null id counts
as the least id; rows equal in id are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplework.llm.common import mix, release, shingle_sets, slices, sql_words
from ripplework.llm.graph import components
from ripplework.session import discard, materialize, table, written

NUM, DEN = 75, 100
RADIUS = 1 - NUM / DEN
#: Shingles are counted in one of so many texts; those that so many of these have are frequent, or fewer, the most frequent ones.
SAMPLED, MET = 16, 4
HOT_ROWS = 1_000_000
#: Points of a region that are compared pair by pair; points of a larger one that decide how it goes on; seeds of a key.
REGION_SETS = 512
SAMPLE = 48
DEEPEST = 4
BLOCK_SETS = 4000
BLOCK_BYTES = 64_000_000
BITS_BYTES = 64_000_000
PIVOTS = 16
PIVOT_BYTES = 32_000_000
MOST_COPIES = 2
LEVELS = 6
NO_ID = -(2**63)
_ENTRY = np.dtype([("h", "<u8"), ("fp", "<u8")])


def fingerprint(s: np.ndarray) -> int:
    """64-bit name of a shingle set, as a signed long."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def prefix_length(n: int, shared: int = 1) -> int:
    """Linked sets of this size share so many of their first shingles."""
    return min(n, n - -(-NUM * n // DEN) + shared)


def ordered(s: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """A set in the global order, and how many of it are not frequent."""
    if not len(hot):
        return s, len(s)
    frequent = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
    return np.concatenate([s[~frequent], s[frequent]]), int(len(s) - frequent.sum())


def first_seeds(s: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """A set's seeds in the global order, and how many of them are not frequent."""
    k = prefix_length(len(s))
    row, rare = ordered(s[: 2 * k], hot)
    if rare < k < len(s):
        row, rare = ordered(s, hot)
    return row[:k], min(rare, k)


def parity(s: np.ndarray) -> bytes:
    """A bit for each class of hashes, set if an odd number of members fall into it; as many bits as members, up to a power of two."""
    bits = max(64, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def possible(n: int, a: int, a_bits: int, m: int, b: int, b_bits: int) -> bool:
    """Whether two sets of n and m shingles with these parities can be linked."""
    while a_bits > b_bits:
        a_bits >>= 1
        a = (a >> a_bits) ^ (a & ((1 << a_bits) - 1))
    while b_bits > a_bits:
        b_bits >>= 1
        b = (b >> b_bits) ^ (b & ((1 << b_bits) - 1))
    # |x ^ y| <= (1 - t) |x | y| and |x | y| = (n + m + |x ^ y|) / 2
    return (a ^ b).bit_count() * (DEN + NUM) <= (DEN - NUM) * (n + m)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def distances(pivot: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(intersection, union) sizes of a pivot with each set."""
    if not sets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(pivot, flat), max(0, len(pivot) - 1))
    hit = (pivot[at] == flat) if len(pivot) else np.zeros(len(flat), bool)
    total = np.concatenate([[0], np.cumsum(hit)])
    ends = np.cumsum(sizes)
    both = total[ends] - total[ends - sizes]
    return both, sizes + len(pivot) - both


def _metric(both: np.ndarray, union: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances, and whether they are links (in whole numbers)."""
    return 1 - both / np.maximum(union, 1), DEN * both >= NUM * union


def _shared_bits(sets: list[np.ndarray]) -> np.ndarray | None:
    """A row of bits for each set, one for each shingle that two sets or more have; none if they take more than BITS_BYTES."""
    known, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[place] > 1
    width = -(-int((counts > 1).sum()) // 64)
    if len(sets) * width * 8 > BITS_BYTES:
        return None
    column = (np.cumsum(counts > 1) - 1)[place[shared]]
    cell = np.repeat(np.arange(len(sets)) * width, [len(s) for s in sets])[shared] + (column >> 6)  # ascending, as sets are
    bits = np.zeros(len(sets) * width, np.uint64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    if len(first):
        bits[cell[first]] = np.bitwise_or.reduceat(np.uint64(1) << (column & 63).astype(np.uint64), first)
    return bits.reshape(len(sets), width)


def join_block(sets: list[np.ndarray]) -> list[int]:
    """The least item number reachable by links from each item, from ascending sets."""
    label = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    bits = _shared_bits(sets) if len(sets) > 2 else None
    eps = 1e-9  # distances are rounded; windows are widened by it, links are whole-number tests

    def linked(p: int, idx: np.ndarray) -> np.ndarray:
        """Distances of an item to others, after joining it with those it links to."""
        if bits is None:
            d, link = _metric(*distances(sets[p], [sets[i] for i in idx]))
        else:
            both = np.bitwise_count(bits[idx] & bits[p]).sum(axis=1, dtype=np.int64)
            both[idx == p] = sizes[p]
            d, link = _metric(both, sizes[idx] + sizes[p] - both)
        found = np.unique(label[idx[link]])
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
        return d

    todo = [label.copy()]
    while todo:
        idx = todo.pop()
        if len(idx) < 2 or (label[idx] == label[idx[0]]).all():
            continue
        p = idx[len(idx) // 2]
        d = linked(p, idx)
        outside = label[idx] != label[p]
        if not outside.any():
            continue
        reach = d[outside].min() - RADIUS - eps
        stay = (outside | (d >= reach)) & (idx != p)  # that one is compared with all
        keep = np.flatnonzero(stay)
        keep = keep[np.argsort(d[keep], kind="stable")]
        cuts = np.flatnonzero(np.diff(d[keep]) > RADIUS + eps) + 1
        for g in np.split(keep, cuts):
            own, dp = idx[g], d[g]
            if len(g) < 24:
                todo.append(own)
                continue
            q = own[np.argmax(dp)]
            e = linked(q, own)
            a, b = (own[(x <= 2 * RADIUS + eps) & (own != q)] for x in (dp - e, e - dp))
            todo += [own[own != q]] if len(a) + len(b) > 1.3 * len(own) else [a, b]
    return label.tolist()


def _batches(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _gathered(parts, rows: int):
    """Joins lists of rows up to about `rows` each."""
    held = []
    for p in parts:
        held += p
        if len(held) >= rows:
            yield held
            held = []
    if held:
        yield held


def _packed(e: np.ndarray, where: np.ndarray) -> pa.RecordBatch | None:
    """(bucket, entries) of entries and their buckets."""
    if not len(e):
        return None
    order = np.argsort(where, kind="stable")
    e, where = e[order], where[order]
    cuts = np.flatnonzero(np.diff(where)) + 1
    rows = [(int(w), x.tobytes()) for w, x in zip(where[np.concatenate([[0], cuts])], np.split(e, cuts), strict=True)]
    return _batches(rows, ["bucket", "entries"], [pa.int32(), pa.binary()])


def _by_bucket(entries: DataFrame, solve, schema: str) -> DataFrame:
    """What solve(bucket, entries) gives, record batches or None, for the distinct entries of each bucket in order."""

    def whole(bucket: int, raw: list[bytes]):
        e = np.concatenate([np.frombuffer(x, _ENTRY) for x in raw])
        e = e[np.lexsort((e["fp"], e["h"]))]
        fresh = np.ones(len(e), bool)
        fresh[1:] = (e["h"][1:] != e["h"][:-1]) | (e["fp"][1:] != e["fp"][:-1])
        e = e[fresh]
        starts = np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]]))
        return solve(bucket, e, starts, np.diff(np.concatenate([starts, [len(e)]])))

    def run(batches):
        now, raw = None, []
        for b in batches:
            for bucket, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now and raw:
                    if (out := whole(now, raw)) is not None:
                        yield out
                    raw = []
                now = bucket
                raw.append(x)
        if raw and (out := whole(now, raw)) is not None:
            yield out

    return entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def frequent_shingles(docs: DataFrame, buckets: int, text_col: str = "text") -> np.ndarray:
    """Hashes, ascending, of the shingles that MET or more of the different texts picked have; at most HOT_ROWS, the most frequent.

    Only the global order rests on them, and it is right for any: equal shingles have one place in it.
    """

    def run(batches):
        seen: set = set()
        for some in _gathered(slices(batches), 2048):
            parts = [np.empty(0, _ENTRY)]
            for s in shingle_sets(t for (t,) in some):
                fp = fingerprint(s)
                if fp not in seen:
                    seen.add(fp)
                    parts.append(np.empty(len(s), _ENTRY))
                    parts[-1]["h"], parts[-1]["fp"] = s, np.uint64(fp + 2**63)
            e = np.concatenate(parts)
            if (out := _packed(e, (mix(e["h"]) % np.uint64(buckets)).astype(np.int64))) is not None:
                yield out
        release()

    def solve(_, e, starts, counts):
        often = counts >= MET
        return pa.RecordBatch.from_arrays([pa.array(e["h"][starts[often]].view(np.int64)), pa.array(counts[often].astype(np.int32))], ["shingle", "texts"])

    picked = docs.where(F.pmod(F.xxhash64(F.col(text_col)), F.lit(SAMPLED)) == 0).select(F.col(text_col))
    met = materialize(_by_bucket(picked.mapInArrow(run, "bucket int, entries binary"), solve, "shingle bigint, texts int"), "frequent")
    least, rows = None, 0
    for texts, n in sorted(met.groupBy("texts").count().collect(), reverse=True):  # a row for each count
        rows += n
        if rows > HOT_ROWS:
            break
        least = texts
    if least is None:
        return np.empty(0, np.uint64)
    return np.sort(met.where(F.col("texts") >= least).select("shingle").toArrow().column(0).to_numpy().view(np.uint64))


def profile(docs: DataFrame, frequent, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, fp, bits, rare, seeds) of every row; rare (how many seeds are not frequent) and seeds once for equal sets of a task."""

    def run(batches):
        hot, seen = frequent.value, set()
        for some in slices(batches):
            out = []
            for (i, _), s in zip(some, shingle_sets(t for _, t in some), strict=True):
                fp, rare, seeds = fingerprint(s), None, None
                if len(s) and fp not in seen:
                    seen.add(fp)
                    row, rare = first_seeds(s, hot)
                    seeds = row.astype("<u8").tobytes()
                out.append((NO_ID if i is None else i, len(s), fp, parity(s), rare, seeds))
            if out:
                yield _batches(out, ["doc_id", "n", "fp", "bits", "rare", "seeds"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()])
            if len(seen) > 100_000:
                seen.clear()
        release()

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "doc_id bigint, n bigint, fp bigint, bits binary, rare int, seeds binary")


def _seeds(known: DataFrame, buckets: int) -> DataFrame:
    """(bucket, entries) of the seeds of each text, packed; frequent seeds have buckets of their own behind the others."""

    def run(batches):
        for some in _gathered(slices(batches), 4096):
            fp, rare, raw = zip(*some, strict=True)
            k = np.array([len(x) // 8 for x in raw])
            e = np.empty(k.sum(), _ENTRY)
            e["h"], e["fp"] = np.frombuffer(b"".join(raw), "<u8"), np.repeat((np.array(fp, np.int64).view(np.uint64) + np.uint64(2**63)), k)
            place = np.arange(len(e)) - np.repeat(np.cumsum(k) - k, k)
            where = (mix(e["h"]) % np.uint64(buckets)).astype(np.int64) + buckets * (place >= np.repeat(np.array(rare), k))
            if (out := _packed(e, where)) is not None:
                yield out
        release()

    return known.where("seeds is not null").select("fp", "rare", "seeds").mapInArrow(run, "bucket int, entries binary")


#: hot and seed together are a seed's place in the global order.
REGIONS = "region bigint, fp bigint, n int, hot boolean, seed bigint"


def _regions(seeds: DataFrame, buckets: int) -> DataFrame:
    """(region, fp, n, hot, seed) of every seed with n points, two or more; of equal regions the one of the first seed stays."""
    names = [x.split()[0] for x in REGIONS.split(", ")]

    def solve(bucket: int, e: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        starts, counts = starts[counts > 1], counts[counts > 1]
        if not len(starts):
            return None
        keep = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        fp = e["fp"][keep]
        begin = np.cumsum(counts) - counts
        with np.errstate(over="ignore"):
            region = mix(np.add.reduceat(mix(fp), begin) + counts.astype(np.uint64))
        _, first = np.unique(region, return_index=True)
        take = np.zeros(len(region), bool)
        take[first] = True
        row = np.repeat(take, counts)
        signed = lambda x: pa.array((x - np.uint64(2**63)).view(np.int64))  # noqa: E731  in the order of the hashes
        cols = [np.repeat(region, counts)[row].view(np.int64), None, np.repeat(counts, counts)[row].astype(np.int32), np.full(int(row.sum()), bucket >= buckets), None]
        cols[1], cols[4] = signed(fp[row]), signed(e["h"][keep][row])
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)

    rows = _by_bucket(seeds, solve, REGIONS)
    return rows.groupBy("region", "fp", "n").agg(F.min(F.struct("hot", "seed")).alias("at")).select("region", "fp", "n", "at.hot", "at.seed")


def _coherent(members: DataFrame) -> DataFrame:
    """(region) of those where most of a sample of (region, fp, n, bits) may be linked to one of the sample."""

    def solve(rows: list[tuple]) -> bool:
        packed = [(n, int.from_bytes(bits, "little"), 8 * len(bits)) for _, n, bits in rows]
        return max(sum(possible(*x, *y) for y in packed) for x in packed) * 2 > len(packed)

    def run(batches):
        now, rows, out = None, [], []
        for b in batches:
            for region, *r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if region != now and rows:
                    out += [(now,)] if solve(rows) else []
                    rows = []
                now = region
                rows.append(r)
        out += [(now,)] if rows and solve(rows) else []
        if out:
            yield _batches(out, ["region"], [pa.int64()])

    return members.select("region", "fp", "n", "bits").repartition("region").sortWithinPartitions("region").mapInArrow(run, "region bigint")


def _extended(keys: DataFrame, texts: DataFrame, frequent, shared: int) -> DataFrame:
    """Regions by one more seed, from (rep, fp, keys (region, seed)) and (rep, text): `shared` is how many seeds a key now has."""

    def run(batches):
        hot = frequent.value
        for some in slices(batches):
            for (fp, keys, _), s in zip(some, shingle_sets(r[2] for r in some), strict=True):
                if fingerprint(s) != fp:
                    continue
                row, rare = ordered(s, hot)
                place = {int(h): i for i, h in enumerate(row.tolist())}
                few = -(-NUM * len(s) // DEN) < shared  # linked sets this small may share less: they meet by this key once more
                row = row[: prefix_length(len(s), shared)]
                for k in keys:
                    at = place[k["seed"] + 2**63] + 1
                    later = row[at:]
                    if few:
                        again = mix(np.array([k["region"]], np.int64).view(np.uint64) + np.uint64(shared))
                        yield pa.RecordBatch.from_arrays([pa.array(again.view(np.int64)), pa.array([fp]), pa.array([at > rare]), pa.array([k["seed"]])], ["region", "fp", "hot", "seed"])
                    if len(later):
                        region = mix(later * np.uint64(0x9E3779B185EBCA87) + mix(np.array([k["region"]], np.int64).view(np.uint64)))
                        cols = [region.view(np.int64), np.full(len(later), fp), np.arange(at, at + len(later)) >= rare, (later - np.uint64(2**63)).view(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["region", "fp", "hot", "seed"])
        release()

    rows = keys.join(texts, "rep").select("fp", "keys", "text").mapInArrow(run, "region bigint, fp bigint, hot boolean, seed bigint")
    rows = materialize(rows.dropDuplicates(["region", "fp"]), "extended")
    n = rows.groupBy("region").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    return materialize(rows.join(n, "region").select("region", "fp", "n", "hot", "seed"), "regions")


def _block_edges(regions: DataFrame, points: DataFrame, texts: DataFrame, frequent, region_sets: int) -> DataFrame:
    """(a, b) that connect all points that may be linked, whatever the size of a region."""
    edges = []
    for shared in range(2, DEEPEST + 2):
        edges.append(materialize(_possible_edges(regions.where(F.col("n") <= region_sets).select("region", "fp").join(points.hint("merge"), "fp")), "possible"))
        large = regions.where(F.col("n") > region_sets)
        hubs = materialize(large.groupBy("region").agg(F.min("fp").alias("hub")), "hubs")
        if not hubs.take(1):
            break
        if shared <= DEEPEST:
            k = F.row_number().over(W.partitionBy("region").orderBy(F.xxhash64("fp", F.lit(17)), "fp"))
            sample = large.select("region", "fp").withColumn("k", k).where(F.col("k") <= SAMPLE).drop("k")
            together = materialize(_coherent(sample.join(points, "fp")), "coherent")
            apart = large.join(together, "region", "left_anti").select("region", "fp", "seed")
            hubs = hubs.join(together, "region", "left_semi")
        edges.append(materialize(large.select("region", "fp").join(hubs, "region").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")), "stars"))
        if shared <= DEEPEST:
            keys = apart.groupBy("fp").agg(F.collect_list(F.struct("region", "seed")).alias("keys"))  # at most a prefix's length
            keys = materialize(keys.join(points, "fp").select("rep", "fp", "keys"), "apart")
            if not keys.take(1):  # texts are not moved for nothing
                break
            regions = _extended(keys, texts, frequent, shared)
    return _union(edges)


def _possible_edges(members: DataFrame) -> DataFrame:
    """(a, b) that connect the points of each region that may be linked, from (region, fp, n, bits)."""

    def solve(rows: list[tuple]):
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        u, packed = _Union(len(rows)), [(int.from_bytes(r[2], "little"), 8 * len(r[2])) for r in rows]
        for i, (fp, n, _) in enumerate(rows):
            for j in range(i + 1, len(rows)):
                m = rows[j][1]
                if NUM * m > DEN * n:
                    break
                if u.find(i) != u.find(j) and possible(n, *packed[i], m, *packed[j]):
                    u.join(i, j)
                    yield fp, rows[j][0]

    def run(batches):
        now, rows, out = None, [], []
        for b in batches:
            for region, *r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if region != now and rows:
                    out += solve(rows)
                    rows = []
                now = region
                rows.append(r)
            if len(out) > 10_000:
                yield _batches(out, ["a", "b"], [pa.int64()] * 2)
                out = []
        out += solve(rows)
        if out:
            yield _batches(out, ["a", "b"], [pa.int64()] * 2)
        release()

    return members.select("region", "fp", "n", "bits").repartition("region").sortWithinPartitions("region").mapInArrow(run, "a bigint, b bigint")


def _join_blocks(points: DataFrame) -> DataFrame:
    """(a, b) that connect the linked points of each block, from (block, fp, shingles)."""

    def solve(rows: dict):
        fps = sorted(rows)
        return [(fps[i], fps[r]) for i, r in enumerate(join_block([np.frombuffer(rows[f], "<u8") for f in fps])) if r != i]

    def run(batches):
        now, rows, out = None, {}, []
        for b in batches:
            for block, fp, s in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if block != now and rows:
                    out += solve(rows)
                    rows = {}
                now = block
                rows[fp] = s
        out += solve(rows)
        if out:
            yield _batches(out, ["a", "b"], [pa.int64()] * 2)
        release()

    return points.select("block", "fp", "shingles").repartition("block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint")


def _split_large(points: DataFrame, block_sets: int, block_bytes: int = BLOCK_BYTES, pivot_bytes: int = PIVOT_BYTES) -> tuple[DataFrame | None, list[DataFrame]]:
    """Splits blocks of more points or bytes by broadcast pivots until none is left: (small blocks, link edges)."""
    spark = points.sparkSession
    small, edges, whole = [], [], []
    for level in range(LEVELS):
        sizes = points.groupBy("block").agg(F.count("*").alias("points"), F.sum(F.length("shingles")).alias("bytes"))
        large = materialize(sizes.where((F.col("points") > block_sets) | (F.col("bytes") > block_bytes) & (F.col("points") > 2)), "large")
        small.append(points.join(large, "block", "left_anti"))
        if not large.take(1):
            if not whole:
                return _union(small), edges
            points = points.limit(0)
            break
        points = points.join(large.select("block"), "block", "left_semi")
        k = F.row_number().over(W.partitionBy("block").orderBy(F.xxhash64("fp", F.lit(level))))
        few = F.greatest(F.lit(2), F.least(F.lit(PIVOTS), F.floor(F.lit(pivot_bytes) / (F.col("bytes") / F.col("points")))))
        pivots = points.withColumn("k", k).where(F.col("k") <= PIVOTS).join(large, "block").where(F.col("k") <= few)
        weight = pivots.groupBy("block").agg(F.sum(F.length("shingles")).alias("w"))
        # a row for each large block, in batches of pivots that together have a bounded size
        weight = weight.withColumn("batch", F.floor(F.sum("w").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)) / pivot_bytes).cast("int"))
        pivots = materialize(pivots.join(weight, "block").select("batch", "block", "fp", "shingles"), "pivots")
        mine = points.join(weight.select("block", "batch"), "block")
        found = []
        for (batch,) in sorted(pivots.select("batch").distinct().collect()):  # numbers of batches
            by_block: dict = {}
            for r in pivots.where(F.col("batch") == batch).collect():  # at most `pivot_bytes` and one block's
                by_block.setdefault(r["block"], []).append((r["fp"], bytes(r["shingles"])))
            shared = spark.sparkContext.broadcast(by_block)

            def run(batches, shared=shared):
                for b in batches:
                    out, rows = [], list(zip(*[c.to_pylist() for c in b.columns], strict=True))
                    by: dict = {}
                    for r in rows:
                        by.setdefault(r[0], []).append(r)
                    for block, own in by.items():
                        sets = [np.frombuffer(r[2], "<u8") for r in own]
                        got = [_metric(*distances(np.frombuffer(s, "<u8"), sets)) for _, s in shared.value[block]]
                        d, link, names = np.array([g[0] for g in got]), np.array([g[1] for g in got]), [f for f, _ in shared.value[block]]
                        out += [(block, r[1], r[2], names, d[:, i].tolist(), link[:, i].tolist()) for i, r in enumerate(own)]
                    if out:
                        yield _batches(out, ["block", "fp", "shingles", "p", "d", "link"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_())])

            schema = "block bigint, fp bigint, shingles binary, p array<bigint>, d array<double>, link array<boolean>"
            found.append(materialize(mine.where(F.col("batch") == batch).select("block", "fp", "shingles").mapInArrow(run, schema), "pivots"))
            shared.unpersist()
        at = _union(found)
        pivot_of = at.select("fp", F.explode(F.arrays_zip(F.col("p").alias("p"), F.col("link").alias("l"))).alias("x"))
        edges.append(pivot_of.where("x.l and x.p <> fp").select(F.col("fp").alias("a"), F.col("x.p").alias("b")))
        outside = at.select("block", F.posexplode(F.arrays_zip("d", "link"))).where("not col.link").groupBy("block", "pos").agg(F.min("col.d").alias("m"))
        outside = materialize(outside.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("pos", "m"))).alias("m")), "outside")  # PIVOTS entries
        joined = at.join(outside, "block", "left")
        done = F.exists(F.transform(F.arrays_zip("d", "link"), lambda x, i: x["link"] & F.coalesce(x["d"] < F.try_element_at("m", i) - RADIUS - 1e-9, F.lit(True))), lambda x: x)
        best = F.array_min("d")
        cells = F.filter(F.transform("d", lambda x, i: F.when(x - best <= 2 * RADIUS + 1e-9, i)), lambda x: x.isNotNull())
        rest = joined.where(~done).select("block", "fp", "shingles", cells.alias("cells"))
        # Where most points lie in most cells, as in a family around one text, another level would only multiply them.
        spread = rest.groupBy("block").agg(F.sum(F.size("cells")).alias("in_cells")).join(large, "block").where(F.col("in_cells") > MOST_COPIES * F.col("points"))
        spread = materialize(spread.select("block"), "spread")
        if spread.take(1):
            whole.append(rest.join(spread, "block", "left_semi").select("block", "fp", "shingles"))
        rest = rest.join(spread, "block", "left_anti").select(F.explode("cells").alias("cell"), "block", "fp", "shingles")
        points = materialize(rest.select(F.xxhash64("block", "cell", F.lit(level)).alias("block"), "fp", "shingles"), "cells")
    points = _union([points.select("block", "fp", "shingles"), *whole])
    # Cells that pivots do not split: every two groups of points, bounded in number and bytes, meet in one task.
    sizes = points.groupBy("block").agg((F.greatest(F.count("*") / (block_sets // 2), 2 * F.sum(F.length("shingles")) / F.lit(block_bytes))).cast("int").alias("g"))
    rows = points.join(sizes, "block").withColumn("s", F.pmod(F.xxhash64("fp", F.lit("salt")), F.col("g") + 1))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g").cast("bigint"))))
    small.append(rows.select(F.xxhash64("block", F.least("s", "t"), F.greatest("s", "t")).alias("block"), "fp", "shingles"))
    return _union(small), edges


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_sets: int = BLOCK_SETS, region_sets: int = REGION_SETS) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, buckets, text_col))
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("rep"), F.col(text_col).alias("text"))
    mark = written()
    known = materialize(profile(docs, frequent, id_col, text_col), "profile")
    points = materialize(known.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("bits").alias("bits")), "points")
    regions = materialize(_regions(_seeds(known, buckets), buckets), "regions")
    rows = materialize(known.select("doc_id", "n", "fp"), "rows")
    discard(spark, mark, written() - mark - 1)  # the profile: its seeds are large
    edges = materialize(_block_edges(regions, points, texts, frequent, region_sets), "edges")
    blocks = materialize(components(edges), "blocks")
    chosen = blocks.join(points.hint("merge"), blocks["node"] == points["fp"]).select(F.col("component").alias("block"), "fp", "rep")
    chosen = materialize(chosen, "chosen")
    # Merge joins where one side grows with the input: the plan is then the same at every size.
    active = materialize(_sets(texts.join(chosen.hint("merge"), "rep").select("block", "fp", "text")).dropDuplicates(["fp"]), "active")
    small, links = _split_large(active, block_sets)
    links = materialize(_union([_join_blocks(small), *links]), "links")
    roots = materialize(components(links), "roots")
    named = roots.join(points.hint("merge"), roots["node"] == points["fp"]).select("component", "fp", "rep")
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = named.join(ids, "component").select("fp", "component_id")
    per_set = points.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "fp").join(per_set.hint("merge"), "fp", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    blank = lambda c: F.when(c != NO_ID, c)
    return out.select(blank(F.col("doc_id")).alias(id_col), F.col("n").alias("n_shingles"), blank(own).alias("component_id"))


def _sets(rows: DataFrame) -> DataFrame:
    """(block, fp, shingles) from (block, fp, text); rows of another text under the same id are left out."""

    def run(batches):
        for some in slices(batches):
            out = []
            for (block, fp, _), s in zip(some, shingle_sets(r[2] for r in some), strict=True):
                if fingerprint(s) == fp:
                    out.append((block, fp, s.astype("<u8").tobytes()))
            if out:
                yield _batches(out, ["block", "fp", "shingles"], [pa.int64(), pa.int64(), pa.binary()])

    return rows.mapInArrow(run, "block bigint, fp bigint, shingles binary")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of near copies (the least id), all columns kept; wordless documents stay.

    Rows that share an id are not told apart: they stay or go together.
    """
    c = link_components(docs, id_col, text_col, **options)
    stay = c.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["__id"]), "left_semi")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {sql_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE unnest_s END AS s FROM (
  SELECT doc_id, w, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS unnest_s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
g AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT g.y, r.c FROM r JOIN g ON g.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) k USING (doc_id)
"""
