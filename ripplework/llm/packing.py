"""Packing documents into near-equal windows by Karmarkar-Karp multiway differencing.

A document is cut into full windows and a remainder; remainders are cut into pieces of at most `piece` tokens. For each
group of remainders (closed by tokens held) the pieces are shared out over k windows: every piece starts as a partial partition, and the two
partial partitions with the largest spread are merged so that the large sums of one meet the small sums of the other,
until one partition is left. k starts at the least that could do and rises whenever a window exceeds the capacity; where
that leaves much padding, as with pieces of one size, the larger pieces are cut in two and shared out again.

The work is done where the documents are read: no shuffle, and memory for one group. Hot sources or copies are like any
other rows. Each group, and so each task, leaves less than a window or two of padding.

Defined results: null text is an empty document (its end id alone); rows are packed one by one, so repeated rows and
equal ids each get pieces of their own and a null id stays null; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import release, slices
from ripplework.llm.tokens import encoder, public_path
from ripplework.session import table

CAPACITY = 1024
PIECE = 256
#: Tokens of remainders that are shared out together, whatever number of documents they come from.
GROUP = 64 * CAPACITY
#: A group whose windows hold less than 1 / SPARE of what they could is cut finer, down to pieces of LEAST tokens.
SPARE = 1.02
LEAST = 16
END_ID = 0
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Shares items out over k subsets: k lists of item numbers with near-equal sums."""
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]  # sums largest first; what is missing is empty
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        if len(b) <= free:
            merged = a + b
        else:  # the largest of b meet empty subsets, the others the smallest of a, largest with smallest
            rest = b[free:]
            merged = a[: len(a) - len(rest)] + b[:free] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(rest, reversed(a[len(a) - len(rest) :]), strict=True)]
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == k else 0
        if low:
            merged = [(s - low, m) for s, m in merged]
        n += 1
        heapq.heappush(heap, (-merged[0][0], n, merged))
    out = []
    for _, members in heap[0][2] if heap else []:
        flat, stack = [], [members]
        while stack:
            x = stack.pop()
            flat.append(x) if isinstance(x, int) else stack.extend(x)
        out.append(sorted(flat))
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most `capacity`; the count rises whenever one is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        out = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return [w for w in out if w]
        k += 1


def pack_rows(rows: Iterator[tuple[int, bytes]], first_sequence: int, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP) -> Iterator[tuple]:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of (doc_id, ids as bytes)."""
    sequence, held, tokens = first_sequence, [], 0

    def flush() -> Iterator[tuple]:
        nonlocal sequence, held, tokens
        while True:
            shares = windows([b - a for *_, a, b in held], capacity)
            largest = max(b - a for *_, a, b in held)
            if len(shares) * capacity <= SPARE * tokens + capacity or largest <= LEAST:
                break
            # pieces of like sizes that do not add up to a window: cut the larger ones in two
            held = [(*d, x, y) for *d, a, b in held for x, y in (((a, (a + b) // 2), ((a + b) // 2, b)) if 2 * (b - a) > largest else ((a, b),))]
        for w in shares:
            at = 0
            for i in w:
                doc_id, whole, total, tail, a, b = held[i]
                yield (doc_id, whole + a, b - a, zlib.crc32(tail[4 * a : 4 * b]), total, sequence, at)
                at += b - a
            sequence += 1
        held, tokens = [], 0

    for doc_id, ids in rows:
        total = len(ids) // 4
        whole = total - total % capacity
        for s in range(0, whole, capacity):
            yield (doc_id, s, capacity, zlib.crc32(ids[4 * s : 4 * (s + capacity)]), total, sequence, 0)
            sequence += 1
        if rest := total - whole:
            parts = -(-rest // piece)
            cuts, tail = [rest * i // parts for i in range(parts + 1)], ids[4 * whole :]
            held += [(doc_id, whole, total, tail, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            tokens += rest
        if tokens >= group:
            yield from flush()
    if held:
        yield from flush()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """One row per piece; a sequence's pieces are its rows in order of `offset`."""

    def run(batches):
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")

        def rows():
            for part in slices(batches):
                for (i, _), ids in zip(part, enc.encode_all([t for _, t in part]), strict=True):
                    yield i, ids + end

        types = [pa.int64()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        out: list[tuple] = []
        for r in pack_rows(rows(), TaskContext.get().partitionId() << 40, capacity, piece, group):
            out.append(r)
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        release()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
