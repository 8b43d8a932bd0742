"""Tables from definitions: {"tables": [{"name", "columns": [{"name", "type", "nullable"}], "rows": [[...]]}]}."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brindle.plans.errors import Code, EngineError

#: The column types a definition may name, and the Python kinds of their cells.
KINDS: dict[str, tuple[T.DataType, tuple[type, ...]]] = {
    "UInt64": (T.LongType(), (int,)),
    "Int64": (T.LongType(), (int,)),
    "Float64": (T.DoubleType(), (float, int)),
    "Utf8": (T.StringType(), (str,)),
    "Boolean": (T.BooleanType(), (bool,)),
}


def _cell(value: Any, kind: str) -> Any:
    """A cell of another kind counts as null, as does a negative number in an unsigned column."""
    data_type, kinds = KINDS[kind]
    if not isinstance(value, kinds) or (isinstance(value, bool) and kind != "Boolean") or (kind == "UInt64" and value < 0):
        return None
    return float(value) if isinstance(data_type, T.DoubleType) else value


def schema(definition: dict) -> T.StructType:
    fields = []
    for c in definition["columns"]:
        if c["type"] not in KINDS:
            raise EngineError(f"unsupported type: {c['type']}", Code.CONFIG)
        fields.append(T.StructField(c["name"], KINDS[c["type"]][0], bool(c.get("nullable", False))))
    return T.StructType(fields)


def table(spark: SparkSession, definition: dict) -> DataFrame:
    """Missing trailing cells are null; a null in a column that is not nullable is an error."""
    made, columns, rows = schema(definition), definition["columns"], []
    for row in definition.get("rows") or []:
        cells = tuple(_cell(row[i] if i < len(row) else None, c["type"]) for i, c in enumerate(columns))
        for cell, field in zip(cells, made.fields, strict=True):
            if cell is None and not field.nullable:
                raise EngineError(f"column {field.name} of {definition['name']} is not nullable", Code.CONFIG)
        rows.append(cells)
    return spark.createDataFrame(rows, made)


def tables(spark: SparkSession, definitions: dict) -> dict[str, DataFrame]:
    """In the order of the definitions."""
    return {d["name"]: table(spark, d) for d in definitions["tables"]}
