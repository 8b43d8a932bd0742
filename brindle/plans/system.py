"""The system catalog: four tables of fixed rows, and information_schema over the session's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG, SCHEMA, SYSTEM = "main", "public", "system"
CREATED = "20260419000000"

# The system tables' columns and rows.  UInt64 is BIGINT here.
COLUMNS = {
    "types": "type_id BIGINT, type_name STRING, category STRING, bytes BIGINT",
    "databases": "database_id BIGINT, database_name STRING, create_time STRING",
    "tables": "table_id BIGINT, database_id BIGINT, table_name STRING, table_type BIGINT, engine BIGINT, column_count BIGINT, create_time STRING",
    "columns": "column_id BIGINT, table_id BIGINT, column_name STRING, ordinal_position BIGINT, type_id BIGINT, nullable BOOLEAN, default_value STRING",
}
ROWS: dict[str, list[tuple]] = {
    "types": [
        (1, "Boolean", "boolean", 1), (2, "Int8", "numeric", 1), (3, "Int16", "numeric", 2), (4, "Int32", "numeric", 4), (5, "Int64", "numeric", 8),
        (6, "UInt8", "numeric", 1), (7, "UInt16", "numeric", 2), (8, "UInt32", "numeric", 4), (9, "UInt64", "numeric", 8),
        (10, "Float32", "numeric", 4), (11, "Float64", "numeric", 8), (12, "Utf8", "string", None), (13, "Date32", "temporal", 4), (14, "Timestamp", "temporal", 8),
    ],
    "databases": [(1, SYSTEM, CREATED)],
}


def _derived() -> None:
    """The rows of ``tables`` and ``columns`` follow from the columns above."""
    type_ids = {"BIGINT": 9, "STRING": 12, "BOOLEAN": 1}
    nullable = {"bytes", "default_value"}
    tables, columns = [], []
    for table_id, (name, text) in enumerate(COLUMNS.items(), 1):
        parts = [c.split() for c in text.split(", ")]
        tables.append((table_id, 1, name, 1, 1, len(parts), CREATED))
        for position, (column, kind) in enumerate(parts, 1):
            columns.append((len(columns) + 1, table_id, column, position, type_ids[kind], column in nullable, None))
    ROWS["tables"], ROWS["columns"] = tables, columns


_derived()


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def values_sql(name: str) -> str:
    """A SELECT of the table's fixed rows, typed."""
    parts = [c.split() for c in COLUMNS[name].split(", ")]
    rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in ROWS[name])
    names = ", ".join(n for n, _ in parts)
    return f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in parts)} FROM (VALUES {rows}) AS t({names})"


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(ROWS[name], COLUMNS[name])


def information_schema(spark: SparkSession, schemas: list[str], catalog: str = CATALOG) -> dict[str, DataFrame]:
    """tables, views, columns, schemata, df_settings, routines and parameters as the session's catalog has them now; system tables stay hidden."""
    tables, views, columns = [], [], []
    for schema in schemas:
        for t in spark.catalog.listTables(schema):
            if t.isTemporary:
                continue
            kind = "VIEW" if t.tableType == "VIEW" else "BASE TABLE"
            tables.append((catalog, schema, t.name, kind))
            if kind == "VIEW":
                views.append((catalog, schema, t.name, None))
            for position, c in enumerate(spark.catalog.listColumns(f"{schema}.{t.name}")):
                columns.append((catalog, schema, t.name, c.name, position, None, "YES" if c.nullable else "NO", c.dataType))
    base = "table_catalog STRING, table_schema STRING, table_name STRING, "
    return {
        "tables": spark.createDataFrame(tables, base + "table_type STRING"),
        "views": spark.createDataFrame(views, base + "definition STRING"),
        "columns": spark.createDataFrame(columns, base + "column_name STRING, ordinal_position BIGINT, column_default STRING, is_nullable STRING, data_type STRING"),
        "df_settings": spark.createDataFrame([(r["key"], r["value"]) for r in spark.sql("SET").collect()], "name STRING, value STRING"),
        "routines": spark.createDataFrame([(catalog, SCHEMA, f.name, "FUNCTION") for f in spark.catalog.listFunctions()], "routine_catalog STRING, routine_schema STRING, routine_name STRING, routine_type STRING"),
        "parameters": spark.createDataFrame([], "specific_catalog STRING, specific_schema STRING, specific_name STRING, ordinal_position BIGINT, parameter_mode STRING, parameter_name STRING, data_type STRING, parameter_default STRING, is_variadic BOOLEAN, rid SMALLINT"),
        "schemata": spark.createDataFrame([(catalog, s, None) for s in [*schemas, "information_schema"]], "catalog_name STRING, schema_name STRING, schema_owner STRING"),
    }
