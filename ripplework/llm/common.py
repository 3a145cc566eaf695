"""What the operators of this subpackage share: word splitting, word hashes and shingle sets."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these bytes; bytes.split() uses the same six.
SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"
SHINGLE_WORDS = 5
_CACHE_WORDS = 150_000
_SLICE = 256
_CHUNK_BYTES = 1 << 18
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A number's first bytes.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def sql_words(text: str) -> str:
    """The same in DuckDB SQL."""
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"


class WordHashes(dict):
    """Stable 64-bit hash of each word, kept for the words met so far up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M3
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, hashes: WordHashes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased.

    Fewer words than `width` make one shingle of the whole sequence; no words make none.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, w), np.uint64, n)
    k = min(width, n)
    h = a[: n - k + 1] * _M1 + np.uint64(k)
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(31))) * _M1 + a[i : n - k + 1 + i]
    return np.unique(mix(h))


def _chunk_sets(raw: list[bytes], width: int) -> Iterator[np.ndarray]:
    buf = b" " + b" ".join(raw) + b" " * 17  # 16 bytes can be read at every word
    space = _IS_SPACE[np.frombuffer(buf, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
    eight = np.ndarray(len(buf) - 7, "<u8", buf, 0, (1,))  # those at each byte
    a = mix(eight[starts] & _FIRST[np.minimum(sizes, 8)] ^ sizes.astype(np.uint64) * _M1)
    a = mix(a ^ eight[starts + 8] & _FIRST[np.clip(sizes - 8, 0, 8)])
    for i in np.flatnonzero(sizes > 16).tolist():
        a[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : starts[i] + sizes[i]])
    begins = np.cumsum([1, *(len(x) + 1 for x in raw)])
    begins[-1] = len(buf)
    firsts = np.searchsorted(starts, begins).tolist()

    def rolled(a: np.ndarray, k: int) -> np.ndarray:
        h = a[: len(a) - k + 1] * _M1 + np.uint64(k)
        for i in range(1, k):
            h = (h ^ (h >> np.uint64(31))) * _M1 + a[i : len(a) - k + 1 + i]
        return mix(h)

    whole = rolled(a, width) if len(a) >= width else a
    for i, j in zip(firsts, firsts[1:], strict=False):
        s = whole[i : j - width + 1].copy() if j - i >= width else rolled(a[i:j], j - i) if j > i else np.empty(0, np.uint64)
        s.sort()
        fresh = s[1:] != s[:-1]
        yield s if fresh.all() else s[np.concatenate([[True], fresh])]


def shingle_sets(texts: Iterable[str | None], width: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """What shingles() gives for each text, by other hashes: words of many texts are hashed at once, up to 16 bytes as two numbers."""
    raw, size = [], 0
    for t in texts:
        raw.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(raw[-1])
        if size >= _CHUNK_BYTES:
            yield from _chunk_sets(raw, width)
            raw, size = [], 0
    if raw:
        yield from _chunk_sets(raw, width)


def slices(batches: Iterable) -> Iterator[list[tuple]]:
    """Rows of Arrow batches, a few hundred at a time: the Python copies of texts stay small."""
    for b in batches:
        for at in range(0, b.num_rows, _SLICE):
            yield list(zip(*[c.to_pylist() for c in b.slice(at, _SLICE).columns], strict=True))


def release() -> None:
    """Gives freed memory back: workers stay for later tasks and hold what they once needed."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass
