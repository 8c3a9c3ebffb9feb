"""What several operators need: inputs, words, hashes of words and of word windows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import scratch_path

#: Rows of texts that a task hands on at a time.
ROWS = 1024
_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers of this machine import the library from wherever the job was begun.

    On a cluster the package is installed or sent along, as ever.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def release() -> None:
    """Give back what this process has freed and still holds, as far as the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_kept: dict[str, Callable[[], None]] = {}


def keep_only(name: str, forget: Callable[[], None]) -> None:
    """What operators remember in a Python worker, which serves one stage after the other:
    when the operator `name` begins, that of all others is dropped. `forget` drops its own."""
    others = [x for x in _kept if x != name]
    for other in others:
        _kept.pop(other)()
    if others:
        release()
    _kept[name] = forget


def slices(batches: Iterator[pa.RecordBatch], n: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, `n` at a time, so that few texts are held as Python's and in results."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words between runs of 0x20 and 0x09 to 0x0D, which is what bytes.split() takes."""
    return text.encode().split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A to Z (and no other letters) in lower case."""
    return text.encode().translate(LOWER).split() if text else []


def hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    if seed:
        return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
    return np.fromiter(map(digest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Windows:
    """Hashes of word windows of any length from one pass over a document's words.

    The hash of a window is a polynomial in its words' hashes, so it depends on the
    words and their order alone, not on where the window lies.
    """

    def __init__(self, word_hashes: np.ndarray):
        n = len(word_hashes)
        self.n = n
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hashes * powers(_STEP, n), out=self.sums[1:])
        self.back = powers(_STEP_INVERSE, n + 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of the window of `length` words at each start."""
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        m = max(0, self.n - length + 1)
        return mix((self.sums[length : length + m] - self.sums[:m]) * self.back[:m])


def shingle_set(words: list[bytes], k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words are one shingle; none, an empty set."""
    if not words:
        return np.empty(0, np.uint64)
    windows = Windows(hashes(words))
    return np.unique(windows.all(min(k, len(words))))
