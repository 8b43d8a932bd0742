"""Which rows of a vector table take part in a search, and their vectors as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(table: DataFrame, id_column: str, vector_column: str, zero_too: bool = False) -> DataFrame:
    """(id, raw): vectors of the most frequent length without null or non-finite components, as little-endian floats of 8 bytes.

    Null vectors, vectors of another length and null ids take no part; zero vectors only if ``zero_too``.
    """
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("id is not null and v is not null")
    n = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = n["n"] if n else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                lists = some.column("v")
                flat = lists.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(lists), width)
                good = np.isfinite(flat).all(axis=1) & (np.ones(len(flat), bool) if zero_too else flat.any(axis=1))
                raw = pa.array([x.tobytes() for x in flat[good].astype("<f8")], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("id").filter(pa.array(good)), raw], ["id", "raw"])

    return rows.where(F.size("v") == width).where(F.lit(width > 0)).mapInArrow(run, "id long, raw binary")


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of :func:`clean`, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)
