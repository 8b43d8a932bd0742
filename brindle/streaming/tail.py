"""Tails of append-only tables.

A table's folder is the stream: files that writers commit are picked up once, and the checkpoint holds the position, so
a restarted query goes on where it stopped.  Event-time state is bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from brindle.operators.keyed import latest


def tail(spark: SparkSession, folder: str, schema: StructType, files: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """The Parquet files of ``folder`` (those that match ``files``) as a stream."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def timed(stream: DataFrame, time: str, late: str = "0 seconds") -> DataFrame:
    """The stream with ``time`` as event time; rows more than ``late`` behind the latest are dropped by what follows."""
    kind = dict(stream.dtypes)[time]
    rows = stream if kind == "timestamp" else stream.withColumn(time, F.col(time).cast("timestamp_ltz"))
    return rows.withWatermark(time, late)


def windowed(rows: DataFrame, time: str, width: str, slide: str | None = None, keys: Sequence[str] = (), aggregates: Sequence[Column] = ()) -> DataFrame:
    """Tumbling (no ``slide``) or sliding windows: w_start, w_end, keys and aggregates (a count by default)."""
    grouped = rows.groupBy(F.window(time, width, slide or width).alias("w"), *keys).agg(*(aggregates or [F.count(F.lit(1)).alias("n")]))
    return grouped.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *[c for c in grouped.columns if c != "w"])


def sessions(rows: DataFrame, time: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column] = ()) -> DataFrame:
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(aggregates or [F.count(F.lit(1)).alias("n")]))
    return grouped.select(F.col("w.start").alias("s_start"), F.col("w.end").alias("s_end"), *[c for c in grouped.columns if c != "w"])


def append_to(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now, then stop."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the stream's whole current result in ``folder``: each batch replaces it."""

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    return stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _listed(spark: SparkSession, path: str, prefix: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def _places(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, list[int]]:
    """Per part the complete versions (less than ``below``) that hold it, in order."""
    found: dict[int, list[int]] = {}
    for version in _listed(spark, folder, "version="):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={version}/_SUCCESS")
        if (below is None or version < below) and done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            for part in _listed(spark, f"{folder}/version={version}", "part="):
                found.setdefault(part, []).append(version)
    return found


def newest_wins(stream: DataFrame, folder: str, key: str, seq: Sequence[str], checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Keep each key's newest row, in ``parts`` parts by the key's hash.

    Batch n merges the parts that its keys fall into with their last versions before n, and writes them as version n; the
    others stay as they are.  So a repeated batch gives the same.  Versions that two later ones supersede go.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = {r["part"] for r in dealt.select("part").distinct().collect()}  # at most ``parts``
        if not touched:
            return
        before = _places(spark, folder, below=number)
        old = [f"{folder}/version={before[p][-1]}/part={p}" for p in touched if p in before]
        rows = batch
        if old:
            rows = spark.read.schema(batch.schema).parquet(*old).unionByName(batch)
        newest = latest(rows, key, seq).select(batch.columns).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        newest.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/version={number}")
        for part in touched & set(before):
            for version in before[part][:-1]:
                gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={version}/part={part}")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_version(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that :func:`newest_wins` keeps now: each part's last complete version."""
    paths = [f"{folder}/version={versions[-1]}/part={part}" for part, versions in sorted(_places(spark, folder).items())]
    return spark.read.parquet(*paths)
