"""Append-only logs over tables: dense sequence numbers, range reads below the durable end, segments and frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.scratch import store


IN_PART = 33  # bits of monotonically_increasing_id that count within a partition


def numbered(table: DataFrame, order: Sequence[str | Column], name: str = "lsn", base: int = 0) -> DataFrame:
    """Dense numbers base, base + 1, ... in ``order``, without one task's sort.

    Rows are exchanged by range, sorted and written once with their partition and place there; a partition's rows start
    at the sum of those before it.  Sizes and rows come from the same files: an exchange by range planned twice may cut
    elsewhere the second time.  Rows equal in ``order`` are numbered in any order, but for good.
    """
    columns, keys = table.columns, [F.col(c).asc() if isinstance(c, str) else c for c in order]
    placed = store(table.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()), "lz4")
    part, inside = F.shiftright("__place", IN_PART), F.col("__place").bitwiseAND((1 << IN_PART) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = placed.join(F.broadcast(before), part == F.col("__part"))
    return joined.select(*columns, (F.col("__before") + inside + base).cast("long").alias(name))


def read(log: DataFrame, start: int, end: int, durable: int | None = None, lsn: str = "lsn") -> DataFrame:
    """start <= lsn < end, in order, and only what is durable."""
    rows = log.where((F.col(lsn) >= start) & (F.col(lsn) < end))
    if durable is not None:
        rows = rows.where(F.col(lsn) <= durable)
    return rows.orderBy(lsn)


def durable_lsn(log: DataFrame, lsn: str = "lsn") -> DataFrame:
    return log.agg(F.max(lsn).alias("durable_lsn"))


def segments(log: DataFrame, per_segment: int, lsn: str = "lsn") -> DataFrame:
    """Per segment of ``per_segment`` records: its number, first and last lsn, and records."""
    return log.groupBy(F.expr(f"{lsn} div {per_segment}").alias("segment")).agg(F.min(lsn).alias("first_lsn"), F.max(lsn).alias("last_lsn"), F.count(F.lit(1)).alias("records"))


def truncate_before(log: DataFrame, keep_from: int, lsn: str = "lsn") -> DataFrame:
    return log.where(F.col(lsn) >= keep_from)


def truncate_after(log: DataFrame, keep_to: int, lsn: str = "lsn") -> DataFrame:
    return log.where(F.col(lsn) <= keep_to)


def _little_endian(number: Column, n_bytes: int) -> Column:
    digits = F.lpad(F.hex(number), 2 * n_bytes, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * (n_bytes - i) - 1, 2) for i in range(n_bytes)]))


def frame(lsn: Column, payload: Column) -> Column:
    """A record on disk: length, crc32 of the rest, lsn (little-endian, 4 + 4 + 8 bytes), payload."""
    number = _little_endian(lsn, 8)
    body = F.concat(number, payload)
    return F.concat(_little_endian(F.octet_length(payload), 4), _little_endian(F.crc32(body), 4), body)


def _number(data: Column, at: int, n_bytes: int) -> Column:
    parts = [F.substring(F.hex(data), 2 * (at + i) + 1, 2) for i in reversed(range(n_bytes))]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def decode(data: Column) -> Column:
    """struct(lsn, payload, state) of one frame: 'ok', 'torn' (shorter than it says) or 'corrupt' (the crc differs)."""
    length, body = _number(data, 0, 4), F.substring(data, 9, 2147483647)
    said = F.octet_length(data)
    payload = F.substring(body, 9, 2147483647)
    state = F.when((said < 16) | (said < length + 16), "torn").when(F.crc32(body) != _number(data, 4, 4), "corrupt").otherwise("ok")
    return F.struct(F.when(state == "ok", _number(data, 8, 8)).alias("lsn"), F.when(state == "ok", payload).alias("payload"), state.alias("state"))


# What a segment's header begins with, and its length with the checksum.
MAGIC, VERSION, HEADER_BYTES = b"WIDX", 1, 36


def index_entry(lsn: Column, offset: Column, length: Column) -> Column:
    """struct(key, value) of an index: the lsn so that bytes sort as numbers, and where its frame lies (8 + 4 bytes)."""
    return F.struct(F.unhex(F.lpad(F.hex(lsn), 16, "0")).alias("key"), F.concat(_little_endian(offset, 8), _little_endian(length, 4)).alias("value"))


def indexed(frames: DataFrame, lsn: str = "lsn", frame_column: str = "frame", per_segment: int = 1 << 20) -> DataFrame:
    """(segment, key, value): the index of frames that lie one after another in segments of ``per_segment`` records."""
    size = F.octet_length(frame_column)
    rows = frames.select(F.expr(f"`{lsn}` div {per_segment}").alias("segment"), F.col(lsn).alias("__lsn"), size.alias("__size"))
    # a segment is one file's worth of records, so its window is bounded
    before = Window.partitionBy("segment").orderBy("__lsn").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("__size").over(before), F.lit(0)).cast("long")
    return rows.select("segment", F.col("__lsn"), "__size", offset.alias("__offset")).select("segment", index_entry(F.col("__lsn"), F.col("__offset"), F.col("__size")).alias("e")).select("segment", "e.key", "e.value")


def decode_entry(key: Column, value: Column) -> Column:
    """struct(lsn, offset, length) of an index entry."""
    return F.struct(F.conv(F.hex(key), 16, 10).cast("long").alias("lsn"), _number(value, 0, 8).alias("offset"), _number(value, 8, 4).alias("length"))


def segment_header(segment: Column, first: Column, last: Column, records: Column) -> Column:
    """A segment's header: magic, version, number, live lsn range and records, little-endian, and their crc32."""
    fields = F.concat(F.lit(MAGIC), _little_endian(F.lit(VERSION), 4), _little_endian(segment, 4), _little_endian(first, 8), _little_endian(last, 8), _little_endian(records, 4))
    return F.concat(fields, _little_endian(F.crc32(fields), 4))


def decode_header(copy_a: Column, copy_b: Column) -> Column:
    """struct(segment, first_lsn, last_lsn, records) of the first of two copies that its crc confirms; null if neither does."""

    def sound(copy: Column) -> Column:
        return (F.octet_length(copy) >= HEADER_BYTES) & (F.crc32(F.substring(copy, 1, HEADER_BYTES - 4)) == _number(copy, HEADER_BYTES - 4, 4))

    header = F.when(sound(copy_a), copy_a).when(sound(copy_b), copy_b)
    fields = {"segment": (8, 4), "first_lsn": (12, 8), "last_lsn": (20, 8), "records": (28, 4)}
    return F.when(header.isNotNull(), F.struct(*[_number(header, at, n).alias(name) for name, (at, n) in fields.items()]))
