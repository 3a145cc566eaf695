"""Token ids in files of patched frame-of-reference blocks.

Ids are cut into blocks. Each block stores its minimum, the differences to it packed at the width that holds the chosen
percentile of them, and an exception list (places and high bits) for the others. A file is: magic, counts, the index of
block starts, the blocks; the index lets a reader decode any run of ids without the blocks before it.

Files are rows of a Parquet table (first_doc, name, payload, document lengths), since executors can write to the shared
store through Spark only. Documents are range-partitioned and sorted by id, so files in name order hold the ids in
ascending order of documents.

Defined results: null text is empty (its end id alone); a null id sorts first; equal ids are ordered by their text's
hash; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplework.llm.common import release, slices
from ripplework.llm.tokens import encoder, public_path
from ripplework.session import materialize, table

BLOCK = 2048
PERCENTILE = 0.95
FILE_IDS = 200_000
END_ID = 2
MAGIC = b"PFR1"
FILES = "part int, name int, docs array<bigint>, lengths array<bigint>, payload binary"


def _pack_bits(v: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = np.unpackbits(np.ascontiguousarray(v, "<u4").view(np.uint8), bitorder="little").reshape(-1, 32)
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def _unpack_bits(raw: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    pad = np.zeros((n, 32), np.uint8)
    pad[:, :width] = bits
    return np.packbits(pad.ravel(), bitorder="little").view("<u4").ravel().astype(np.uint64)


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    d = ids.astype(np.uint64) - np.uint64(low)
    k = min(len(d) - 1, int(percentile * len(d)))
    width = int(np.partition(d, k)[k]).bit_length()
    odd = np.flatnonzero(d >> np.uint64(width))
    head = struct.pack("<IHBH", low, len(d), width, len(odd))
    return head + _pack_bits(d, width) + odd.astype("<u2").tobytes() + (d[odd] >> np.uint64(width)).astype("<u4").tobytes()


def decode_block(raw: bytes) -> np.ndarray:
    low, n, width, odd = struct.unpack_from("<IHBH", raw)
    at = 9 + -(-n * width // 8)
    d = _unpack_bits(raw[9:at], n, width)
    places = np.frombuffer(raw, "<u2", odd, at)
    d[places] |= np.frombuffer(raw, "<u4", odd, at + 2 * odd).astype(np.uint64) << np.uint64(width)
    return (d + np.uint64(low)).astype("<u4")


def encode_file(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    blocks = [encode_block(ids[i : i + block], percentile) for i in range(0, len(ids), block)]
    starts = np.cumsum([0] + [len(b) for b in blocks]).astype("<u8")
    return MAGIC + struct.pack("<QII", len(ids), block, len(blocks)) + starts.tobytes() + b"".join(blocks)


def decode_file(raw: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start..stop of a file; only the blocks that hold them are read."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    n, block, count = struct.unpack_from("<QII", raw, 4)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, "<u4")
    index, body = np.frombuffer(raw, "<u8", count + 1, 20), 20 + 8 * (count + 1)
    first, last = start // block, (stop - 1) // block
    out = np.concatenate([decode_block(raw[body + int(index[i]) : body + int(index[i + 1])]) for i in range(first, last + 1)])
    return out[start - first * block : stop - first * block]


def write(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block: int = BLOCK, percentile: float = PERCENTILE, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files of a corpus to the shared folder and returns their table."""

    def run(batches):
        from pyspark import TaskContext

        enc, end, part, name = encoder(tokenizer, 1_700_000), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        held, lengths, raw, size = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(raw), "<u4")
            row = [[part], [name], [list(held)], [list(lengths)], [encode_file(ids, block, percentile)]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], ["part", "name", "docs", "lengths", "payload"])

        for some in slices(batches):
            for (i, _), ids in zip(some, enc.encode_all([t for _, t in some]), strict=True):
                raw.append(ids + end)
                held.append(i)
                lengths.append(len(raw[-1]) // 4)
                size += lengths[-1]
                if size >= file_ids:
                    yield flush()
                    name += 1
                    held, lengths, raw, size = [], [], [], 0
        if held:
            yield flush()
        release()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(run, FILES), "token-files")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    sizes = files.select("part", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each partition that wrote
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    sizes = files.select("part", "name", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    inside = sizes.select("part", "name", (F.sum("n").over(W.partitionBy("part").orderBy("name")) - F.col("n")).alias("file_start"))
    starts = inside.join(parts, "part").select("part", "name", (F.col("file_start") + F.col("part_start")).alias("begin"))

    def run(batches):
        for b in batches:
            for part, name, docs, lengths, payload in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ids = decode_file(payload)
                ends = np.cumsum(lengths)
                begins = ends - np.asarray(lengths)
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [[part] * len(docs), [name] * len(docs), docs, begins.tolist(), lengths, crc]
                types = [pa.int32(), pa.int32()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["part", "name", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = files.mapInArrow(run, "part int, name int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, ["part", "name"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json")))
