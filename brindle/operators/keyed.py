"""Key-ordered tables: bounded scans, seeks, merges and newest-wins reads over rows (key, value, deleted, seq).

A table is any DataFrame with a key column; layers are tables of the same columns, newest first.  Scans are filters on
the key, which reach the Parquet reader as pushed predicates, so row groups outside the bounds are not read.  An order
is a range exchange and a sort within partitions; a seek is a limit of one, which Spark runs as a top-1 per partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """One end of a key range."""

    value: Any = None
    kind: str = "unbounded"

    @staticmethod
    def included(value: Any) -> Bound:
        return Bound(value, "included")

    @staticmethod
    def excluded(value: Any) -> Bound:
        return Bound(value, "excluded")


UNBOUNDED = Bound()


def within(key: Column, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> Column:
    test = F.lit(True)
    if lower.kind != "unbounded":
        test = key >= F.lit(lower.value) if lower.kind == "included" else key > F.lit(lower.value)
    if upper.kind != "unbounded":
        test = test & (key <= F.lit(upper.value) if upper.kind == "included" else key < F.lit(upper.value))
    return test


def range_scan(table: DataFrame, key: str, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, reverse: bool = False, then: Sequence[str] = ()) -> DataFrame:
    """The rows of a key range in key order; tombstones are rows like any other."""
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in (key, *then)]
    return table.where(within(F.col(key), lower, upper)).orderBy(*order)


def get(table: DataFrame, key: str, value: Any) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def seek(table: DataFrame, key: str, target: Any, reverse: bool = False) -> DataFrame:
    """Forward: the first row at or after ``target``; reverse: the last at or before it.  No row if there is none."""
    if reverse:
        return table.where(F.col(key) <= F.lit(target)).orderBy(F.col(key).desc()).limit(1)
    return table.where(F.col(key) >= F.lit(target)).orderBy(F.col(key).asc()).limit(1)


def _layered(layers: Sequence[DataFrame], layer: str) -> DataFrame:
    out = layers[0].withColumn(layer, F.lit(0))
    for number, df in enumerate(layers[1:], 1):
        out = out.unionByName(df.withColumn(layer, F.lit(number)))
    return out


def merge(layers: Sequence[DataFrame], key: str, reverse: bool = False, layer: str = "layer") -> DataFrame:
    """All rows of all layers by key, equal keys by layer: nothing is dropped."""
    order = F.col(key).desc() if reverse else F.col(key).asc()
    return _layered(layers, layer).orderBy(order, F.col(layer).asc())


def shadow(layers: Sequence[DataFrame], key: str, layer: str = "layer") -> DataFrame:
    """One row a key: that of the first layer that has it.  An aggregate, so it combines before the exchange."""
    rest = [c for c in layers[0].columns if c != key]
    rows = _layered(layers, layer)
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest, layer), layer).alias("__first"))
    return first.select(key, "__first.*")


def latest(table: DataFrame, key: str, seq: Sequence[str]) -> DataFrame:
    """One row a key: that of the largest ``seq``, tombstones included."""
    rest = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("__last")).select(key, "__last.*")


def live(table: DataFrame, deleted: str = "deleted") -> DataFrame:
    return table.where(~F.col(deleted))


def write_batch(table: DataFrame, base_seq: int = 0, order: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """Number a batch's rows base_seq, base_seq + 1, ... in ``order``, without a single-task sort: see :func:`numbered`."""
    from .log import numbered

    return numbered(table, order, seq, base_seq)


def compact(table: DataFrame, key: str, seq: Sequence[str], deleted: str = "deleted") -> DataFrame:
    """The table without shadowed rows and tombstones."""
    return live(latest(table, key, seq), deleted)
