"""Small helpers the operators share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspan.session import ship_package

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: What a worker keeps between tasks. Operators with large tables of their own empty it first.
KEPT: dict = {}


def clear_kept() -> None:
    """Empty ``KEPT``, and give back to the system what this worker then holds for nothing: freed memory else stays with it."""
    KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The rows no label may be learned from: one fold in five by the checksum of the id; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit value for each word. bytes.split() knows just the six ASCII white-space characters."""
    w = (text or "").encode("utf-8", "surrogatepass").split()
    return mix(np.fromiter(map(zlib.crc32, w), np.uint64, len(w)) + (np.fromiter(map(len, w), np.uint64, len(w)) << np.uint64(32)))


def strong_word_hashes(text: str | None) -> np.ndarray:
    """As ``word_hashes``, from a hash of 64 bits: for results that rest on equality of hashes alone."""
    w = (text or "").encode("utf-8", "surrogatepass").split()
    return mix(np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The multiplier of ``rolling`` and its inverse modulo 2 ** 64, and how many values are worked on at once.
_BASE, _STRETCH = 0x9E3779B97F4A7C15, 1 << 16
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier from 0 up, and those of its inverse."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(2 * _STRETCH, base, np.uint64)
            row[0] = 1
            _POWERS.append(np.multiply.accumulate(row))
    return _POWERS[0], _POWERS[1]


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive values (fewer than a stretch); none if there are fewer.

    A run's hash is its values times falling powers of the multiplier. It is taken as the difference of two prefix sums
    with powers of the inverse, so a value costs the same whatever the width.
    """
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers()
    out = np.empty(m, np.uint64)
    for lo in range(0, m, _STRETCH):
        part = h[lo : min(lo + _STRETCH, m) + n - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * down[: len(part)], out=sums[1:])
        k = len(part) - n + 1
        out[lo : lo + k] = (sums[n:] - sums[:-n]) * up[n - 1 : n - 1 + k]
    return mix(out)


def rolling_at(h: np.ndarray, n: int, places: np.ndarray) -> np.ndarray:
    """``rolling`` for the runs that begin at these places alone."""
    out = np.zeros(len(places), np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + h[places + k]
    return mix(out)


def with_python(df: DataFrame) -> DataFrame:
    ship_package(df.sparkSession)
    return df


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``size`` rows, so that long texts are not held many at a time."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
