"""Scratch tables in the cluster's shared folder, deleted when the driver's Python ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}  # per application in local mode, its folder where none is named


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only local mode may fall back to one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = "file://" + tempfile.mkdtemp(prefix="brindle-")
    return _own[application]


def folder(spark: SparkSession, name: str = "brindle", below: str | None = None) -> str:
    """A new folder's path below the shared one, or ``below``; what is written there goes with the driver's Python."""
    path = f"{(below or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def store(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a scratch table and read it back.

    This cuts lineage: a lost executor costs a reread of files, not a recomputation.
    The files go when the driver's Python ends, or with :func:`discard`.
    """
    path = folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a scratch table that no later plan reads."""
    scratch = {p for _, p in _written}
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for path in [p for p in scratch if root.rstrip("/").endswith(p.rsplit("/", 1)[1])]:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session or its JVM has ended
            return
