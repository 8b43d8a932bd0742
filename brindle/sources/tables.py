"""Table sources and sinks: Parquet directories, external files of the common formats, and VALUES."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "ndjson": "json", "orc": "orc", "avro": "avro", "text": "text"}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_external(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A file or folder of one of FORMATS.  Without a schema, CSV and JSON infer one from the data."""
    form = FORMATS[kind.lower()]
    reader = spark.read.format(form).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif form == "csv":
        reader = reader.option("inferSchema", options.get("inferSchema", "true")).option("header", options.get("header", "true"))
    return reader.load(path)


def write_external(df: DataFrame, path: str, kind: str, mode: str = "errorifexists", partition_by: Sequence[str] = (), **options: str) -> None:
    form = FORMATS[kind.lower()]
    writer = df.write.format(form).mode(mode).options(**({"header": "true"} if form == "csv" else {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def values(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """A preloaded table."""
    return spark.createDataFrame(list(rows), schema)
