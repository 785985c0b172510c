"""Words and word shingles of whole texts as 64-bit hashes, computed per batch with numpy.

A word is a run of bytes other than space and \\t..\\r; A-Z are lower-cased.
Everything here runs inside Spark tasks on bounded batches of rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once. A longer text forms a batch of its own.
CHUNK_BYTES = 1 << 20


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives freed memory back when it ends: a Python worker outlives its task, and idle ones count to their executor."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return kept


def give_back() -> None:
    """Returns what the allocators of Arrow and, where it is glibc, of the process hold but do not use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(seed: int = 7) -> np.ndarray:
    """A random 64-bit number for each byte value."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)


class WordHasher:
    """Hashes the words of many texts at once; keeps its power tables between calls."""

    def __init__(self) -> None:
        self.codes = byte_codes()
        lower = np.arange(256)
        lower[65:91] += 32
        self.codes = self.codes[lower]
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def spans(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The joined buffer, start and end of each word in it, and the first word of each text (one more at the end)."""
        buffer = b" ".join([b"", *texts, b""])
        data = np.frombuffer(buffer, dtype=np.uint8)
        space = self.space[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        return buffer, starts, ends, first

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and the first word of each text (one more at the end)."""
        buffer, starts, ends, first = self.spans(texts)
        return self.hashes(np.frombuffer(buffer, dtype=np.uint8), starts, ends), first

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each stretch of ``data``; none starts at its first byte."""
        if len(self.up) < len(data):
            self.up, self.down = powers(BASE, 2 * len(data)), powers(BASE_INVERSE, 2 * len(data))
        total = np.cumsum(self.codes[data] * self.up[: len(data)], dtype=np.uint64)
        hashes = (total[ends - 1] - total[starts - 1]) * self.down[starts]
        return mixed(hashes + (ends - starts).astype(np.uint64))

    def shingles(self, texts: list[bytes], width: int) -> Iterator[np.ndarray]:
        """For each text the sorted distinct hashes of its runs of ``width`` words.

        A text with fewer words has one shingle, the whole sequence; a text
        without words has none.
        """
        word, first = self.words(texts)
        joined = word.copy()
        for k in range(1, width):
            joined[: len(word) - k] = mixed(joined[: len(word) - k] * np.uint64(BASE) + word[k:])
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= width:
                own = np.sort(joined[lo : hi - width + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif hi > lo:
                one = word[lo : lo + 1]
                for k in range(1, hi - lo):
                    one = mixed(one * np.uint64(BASE) + word[lo + k : lo + k + 1])
                yield mixed(one + np.uint64(hi - lo))
            else:
                yield word[:0]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces_of(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows in slices of at most ``limit`` text bytes (at least one row), with their texts as bytes."""
    for batch in batches:
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        lo = size = 0
        for hi, t in enumerate(texts):
            if hi > lo and size + len(t) > limit:
                yield batch.slice(lo, hi - lo), texts[lo:hi]
                lo, size = hi, 0
            size += len(t)
        if lo < len(texts):
            yield batch.slice(lo), texts[lo:]
