"""What several operators share: words, 64-bit hashes, output in batches of bounded size."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..storage import at_most, discard, hot_from, join_counted, stored  # noqa: F401  (used by the operators)

#: Bytes of text that a Python worker handles at once; a longer text is handled by itself.
AT_ONCE = 4 << 20
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; forgets everything when it holds `most` words, so memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_hash(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each k consecutive word hashes, in order: len(h) - k + 1 values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, acc = np.uint64(0x9E3779B97F4A7C15 + 2 * seed), np.full(n, seed + 1, np.uint64)
    for j in range(k):
        acc = acc * base + h[j : j + n]
    return mix(acc)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The whole texts of a batch as UTF-8; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def give_back() -> None:
    """Returns freed memory to the system; a worker would keep it, for as long as it waits for the next stages' tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_parts(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE, name: str = "text") -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in parts of at most `most` bytes of text or of one row.

    An Arrow batch has up to 10,000 rows, and the work on texts takes several times their size.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        ends, done = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)), 0
        while done < batch.num_rows:
            before = ends[done - 1] if done else 0
            to = max(done + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(done, to - done)
            give_back()
            done = to


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
