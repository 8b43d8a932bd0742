"""What the corpus operators share: scratch tables in the cluster's shared folder, table loading, joins with hot keys."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.scratch import discard, folder, shared_folder, store

__all__ = ["ascii_lower", "crc_bucket", "discard", "folder", "release", "shared_folder", "store", "store_bucketed", "table", "tidy"]

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MOST_BUCKETS = 100_000  # Spark's own limit


def _times(a: np.ndarray, b: int) -> np.ndarray:
    return a * np.uint32(b)


def _turned(a: np.ndarray, n: int) -> np.ndarray:
    return (a << np.uint32(n)) | (a >> np.uint32(32 - n))


def bucket_of(numbers: np.ndarray, buckets: int) -> np.ndarray:
    """The hash bucket that Spark puts each long into: 32-bit Murmur3 with its constants and seed."""
    h = np.full(len(numbers), 42, dtype=np.uint32)
    for half in (numbers & 0xFFFFFFFF, numbers >> 32):
        k = _times(_turned(_times(half.astype(np.uint32), 0xCC9E2D51), 15), 0x1B873593)
        h = _times(_turned(h ^ k, 13), 5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = _times(h ^ (h >> np.uint32(16)), 0x85EBCA6B)
    h = _times(h ^ (h >> np.uint32(13)), 0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % buckets


def numbers_for(part: int, buckets: int, turns: int) -> Iterator[int]:
    """Numbers of a partition's own that lie in ``turns`` buckets in turn: what has them is written to so many files."""
    wanted = [(part * turns + t) % buckets for t in range(turns)]
    found: list[list[int]] = [[] for _ in wanted]
    at = part << 32
    while True:
        for own in found:
            while not own:
                some = np.arange(at, at + 64 * buckets, dtype=np.int64)
                at += len(some)
                where = bucket_of(some, buckets)
                for k, w in enumerate(wanted):
                    found[k] += some[where == w].tolist()
            yield own.pop(0)


def store_bucketed(df: DataFrame, column: str, buckets: int, dealt: bool = False) -> DataFrame:
    """As :func:`store`, in hash buckets of ``column``: joins on it then leave these rows where they are.

    ``dealt``: the rows lie by bucket already, or by such numbers as :func:`numbers_for` gives.  The catalog entry that buckets need goes at once; the rows stay, being an external table's, as long as others' do.
    """
    spark, buckets = df.sparkSession, min(buckets, MOST_BUCKETS)
    path = folder(spark)
    name = "default." + path.rsplit("/", 1)[1].replace("-", "_")
    (df if dealt else df.repartition(buckets, column)).write.bucketBy(buckets, column).option("path", path).option("compression", "none").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def forget_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of steps whose results are stored deleted: Spark does so when the driver's JVM collects its
    garbage, which else may be long after."""
    spark._jvm.System.gc()


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task by a minute, next to others at work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a partition's batches that gives its memory back when it is through."""

    def through(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return through


def crc_bucket(doc_id: F.Column, modulus: int) -> F.Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def ascii_lower(column: F.Column) -> F.Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


MOST_HOT = 100_000  # keys with more than this share of all rows' count are at most so many


def hot_limit(rows: int, least: int = 1024) -> int:
    """The count from which on a key counts as hot: the keys at or above it number at most MOST_HOT among ``rows`` rows."""
    return max(least, -(-rows // MOST_HOT))


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, limit: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` (one row a key, ``count``: how many rows have it) on ``keys``.

    Rows of hot keys stay where they are and meet a broadcast of these keys' rows, bounded by :func:`hot_limit`; the others
    are exchanged, at most ``limit`` rows a key.
    """
    hot = F.broadcast(keyed.where(F.col(count) >= limit).withColumn("__hot", F.lit(True)))
    tried = rows.join(hot, keys, "left")
    cold = tried.where(F.col("__hot").isNull()).select(rows.columns).join(keyed.where(F.col(count) < limit), keys, how)
    return tried.where("__hot").drop("__hot").select(cold.columns).unionByName(cold)
