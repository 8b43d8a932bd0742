"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id, place), place being a row's own number in the written input, so that no two
rows are equal in the order.  Splitters, one less than there are shards, are found by counting, exactly and on all
partitions at once, the bytes below a few candidate keys, and narrowing the candidates until each splitter is within
tolerance of its share of the bytes.  Only then do rows move, once.

Equal texts are neighbours in the order.  A splitter falls between two texts wherever such a place lies within
``group_slack`` of the target; a larger group of copies is split inside, by doc_id, and rows of one id by place.

Defined results: a null text counts as empty (size 1, crc32 0); a null doc_id sorts first; rows that are repeated whole
are counted each, and split where they outgrow a shard; an empty table gives no rows; other columns of the input are not
looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import store, tidy

LOWEST = -(2**63)
#: A key is one number: the hash of the text and the id, each from its least value on, and the place, in 64 bits each.
BITS = 64
LEVELS = (1 << 2 * BITS, 1 << BITS, 1)
TOP = 1 << 3 * BITS


def sized(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, text_crc32 and the sort key's first part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )


def parts_of(key: int) -> tuple[int, int, int]:
    """(hash, id, place) of a key."""
    low = (1 << BITS) - 1
    return (key >> 2 * BITS) + LOWEST, ((key >> BITS) & low) + LOWEST, key & low


def cells(hashes: np.ndarray, ids: np.ndarray, places: np.ndarray, probes: list[int]) -> np.ndarray:
    """For each row the number of probes (in order) at or below its key."""
    split = [parts_of(p) for p in probes]
    out = np.searchsorted(np.array([h for h, _, _ in split], dtype=np.int64), hashes, side="right")
    inner: dict[int, list[tuple[int, int]]] = {}
    for h, i, place in split:
        if (i, place) != (LOWEST, 0):
            inner.setdefault(h, []).append((i, place))
    for h, bounds in inner.items():  # at most ``fan`` per splitter
        at = np.flatnonzero(hashes == h)
        for i, place in bounds:
            out[at] -= (ids[at] < i) | ((ids[at] == i) & (places[at] < place))
    return out


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column("text_hash").to_numpy(), batch.column("doc_id").fill_null(LOWEST).to_numpy(), batch.column("place").to_numpy()


def bytes_below(rows: DataFrame, probes: list[int]) -> list[int]:
    """Exact bytes of the rows below each probe: one partial sum per partition and cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(probes) + 1, dtype=np.int64)
        for batch in batches:
            np.add.at(sums, cells(*_keys(batch), probes), batch.column("size").to_numpy())
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["cell", "bytes"])

    found = dict(rows.mapInArrow(tidy(count), "cell long, bytes long").groupBy("cell").agg(F.sum("bytes")).collect())  # a row a probe
    return np.cumsum([found.get(c, 0) for c in range(len(probes))]).tolist()


class _Search:
    """One splitter: the bytes that should lie below it, and the keys it lies between."""

    def __init__(self, target: float, total: int):
        self.target, self.low, self.high = target, 0, TOP
        self.below_low, self.below_high = 0, total
        self.found: int | None = None

    def probes(self, fan: int) -> list[int]:
        """Up to ``fan`` - 1 evenly spaced keys inside the interval, at the coarsest level that has any there."""
        for unit in LEVELS:
            first, last = self.low // unit + 1, -(-self.high // unit) - 1
            if first <= last:
                return sorted({unit * (first + (last - first) * k // max(fan - 2, 1)) for k in range(fan - 1)})
        return []

    def narrow(self, probes: list[int], below: list[int], tolerance: float, slack: float) -> None:
        right = bisect.bisect_left(below, self.target)
        if right < len(probes) and probes[right] < self.high:
            self.high, self.below_high = probes[right], below[right]
        if right and probes[right - 1] > self.low:
            self.low, self.below_low = probes[right - 1], below[right - 1]
        ends = [(abs(self.target - self.below_low), self.low), (abs(self.below_high - self.target), self.high)]
        gap, key = min(ends)
        if gap <= tolerance or not self.probes(3):
            self.found = key
        elif -(-self.high // LEVELS[0]) - 1 < self.low // LEVELS[0] + 1:  # inside one text's group
            between = [(g, k) for g, k in ends if k % LEVELS[0] == 0 and g <= slack]
            self.found = min(between)[1] if between else None


def splitters(rows: DataFrame, shards: int, tolerance: float, group_slack: float, fan: int = 16) -> list[int]:
    """Keys that cut ``rows`` into ``shards`` runs of near equal bytes; both limits are in bytes.  A round counts below at
    most (shards - 1) * (fan - 1) probes, whatever the number of rows."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    searches = [_Search(total * k / shards, total) for k in range(1, shards)]
    for _ in range(3 * BITS):  # each round divides the open intervals by about fan; the key's bits end well before this
        open_ = [s for s in searches if s.found is None]
        probes = sorted({p for s in open_ for p in s.probes(fan)})
        if not probes:
            break
        below = bytes_below(rows, probes)
        for s in open_:
            s.narrow(probes, below, tolerance, group_slack)
    return sorted(s.low if s.found is None else s.found for s in searches)


SIZED = "doc_id long, size long, text_crc32 long, text_hash long, place long"


def shard(rows: DataFrame, shards: int = 16, tolerance: float = 0.001, group_slack: float = 0.01, part_bytes: int = 256 << 20) -> DataFrame:
    """Deal ``rows`` (as :func:`sized` gives them) into ``shards`` of near equal bytes.

    ``tolerance`` and ``group_slack`` are shares of one shard's bytes.  A shard's rows are dealt, by their place's hash, to
    as many tasks as ``part_bytes`` of text ask for; a row's slot is its rank there after the rows of the shard's earlier
    parts.  The driver holds the splitters alone.
    """
    spark = rows.sparkSession
    rows = store(rows.withColumn("place", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("size")).first()[0] or 0
    per_shard = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards), -(-total // (part_bytes * shards)), 1)
    cuts = splitters(rows, shards, tolerance * total / shards, group_slack * total / shards)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells(*_keys(batch), cuts), pa.int32())], [*batch.schema.names, "shard"])

    placed = rows.mapInArrow(tidy(place), SIZED + ", shard int").withColumn("part", F.pmod(F.xxhash64("place"), F.lit(per_shard)))
    sizes = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first_slot"))
    order = Window.partitionBy("shard", "part").orderBy("text_hash", F.asc_nulls_first("doc_id"), "place")
    ranked = placed.withColumn("rank", F.row_number().over(order)).join(first, ["shard", "part"])
    return ranked.select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
