"""The system catalog, information_schema, version() and the statements that are no queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import render
from brindle.plans import system as catalog
from brindle.plans.engine import build_version
from brindle.plans.errors import EngineError
from brindle.sources import scratch

from .base import BUILT, COMMIT, Entry, engine, sql

V = {n: f"({catalog.values_sql(n).replace('STRING', 'VARCHAR')})" for n in catalog.COLUMNS}


def _fill(text: str, sf_dir: str, folder: str) -> str:
    return text.replace("<sf>", sf_dir).replace("<scratch>", folder)


def script(*texts: str, oracle: str) -> Entry:
    """Statements one after another in a schema that is emptied first; the rows of the last, a query.

    <sf> is the tables' folder and <scratch> a new one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at, folder = engine(spark), scratch.folder(spark, "script")
        _empty(at)
        for text in texts[:-1]:
            at.execute(_fill(text, sf_dir, folder))
        found = scratch.store(at.execute(_fill(texts[-1], sf_dir, folder)).frame)
        _empty(at)
        return found

    return Entry(run, oracle)


def answers(*texts: str, oracle: str) -> Entry:
    """What each statement answers: its tag, its count of rows or queried rows, or its SQLSTATE."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at, folder, rows = engine(spark), scratch.folder(spark, "answers"), []
        _empty(at)
        for number, text in enumerate(texts, 1):
            try:
                got = at.execute(_fill(text, sf_dir, folder))
                rows.append((number, got.tag, got.frame.count() if got.frame is not None else got.rows, None))
            except EngineError as e:
                rows.append((number, None, None, e.sqlstate))
        _empty(at)
        return at.spark.createDataFrame(rows, "step INT, tag STRING, n BIGINT, sqlstate STRING")

    return Entry(run, oracle)


def _empty(at) -> None:
    """Drop what an earlier script left."""
    for name in at.table_names():
        at.spark.sql(f"DROP {'VIEW' if at.spark.catalog.getTable(name).tableType == 'VIEW' else 'TABLE'} IF EXISTS `{name}`")
    at._resolve()


def _text(spark, sf_dir):
    at = engine(spark)
    rows = render.text_rows(at.query("SELECT 1::BIGINT AS a, TRUE AS b, 0.1::DOUBLE AS c, 1e20::DOUBLE AS d, NULL AS e, DATE '2024-02-29' AS f, [1, NULL, 3] AS g"))
    return at.spark.createDataFrame([(k, v) for k, v in enumerate(rows[0])], "at INT, text STRING")


def _json(spark, sf_dir):
    import json

    at = engine(spark)
    return at.spark.createDataFrame([(json.dumps(render.json_response(at.query("SELECT 'Ada' AS name, 36 AS age, '36' AS said"))),)], "json STRING")


def _preloaded(spark, sf_dir):
    at = engine(spark)
    _empty(at)
    at.register("crew", at.spark.createDataFrame([("Ada", 36), ("Ben", 7)], "name STRING, years INT"))
    rows = [("registered", at.table_exists("crew")), ("listed", at.table_names() == ["crew"]), ("counted", at.row_count("crew") == 2), ("system hidden", "types" not in at.table_names() and at.table_exists("types"))]
    try:
        at.register("crew", at.spark.range(1))
    except EngineError as e:
        rows.append((str(e), True))
    rows += [("dropped", at.deregister("crew") and not at.table_exists("crew")), ("system stays", not at.deregister("types")), ("schemas", at.schemas() == ["public"])]
    return at.spark.createDataFrame(rows, "what STRING, holds BOOLEAN")


ORDERS = "CREATE EXTERNAL TABLE o STORED AS PARQUET LOCATION '<sf>/orders.parquet'"

ENTRIES: dict[str, Entry] = {
    **{f"sys_{name}": sql(f"SELECT * FROM {'system.' if k % 2 else ''}{name}", catalog.values_sql(name).replace("STRING", "VARCHAR")) for k, name in enumerate(catalog.COLUMNS)},
    "sys_columns_join": sql("SELECT table_name, column_name, ordinal_position, type_name, nullable FROM system.tables JOIN system.columns USING (table_id) JOIN types USING (type_id)", f"SELECT table_name, column_name, ordinal_position, type_name, nullable FROM {V['tables']} a JOIN {V['columns']} b USING (table_id) JOIN {V['types']} c USING (type_id)"),
    "version_udf": sql("SELECT version() AS version, 'version()' AS text", f"SELECT '{build_version(COMMIT, BUILT)}' AS version, 'version()' AS text"),
    "stmt_insert": script(
        "CREATE TABLE crew(name VARCHAR, years INT)", "INSERT INTO crew VALUES ('Ada', 36), ('Ben', NULL)", "INSERT INTO crew (years, name) SELECT years / 5, name FROM crew", "SELECT name, years FROM crew",
        oracle="SELECT * FROM (VALUES ('Ada', 36), ('Ben', NULL), ('Ada', 7), ('Ben', NULL)) t(name, years)"),
    "stmt_answers": answers(
        "CREATE TABLE crew(name VARCHAR, years INT)", "INSERT INTO crew VALUES ('Ada', 36), ('Ben', 7)", "INSERT INTO crew SELECT * FROM crew", "SELECT * FROM crew", "SET TIME ZONE 'UTC'", "INSERT OVERWRITE crew VALUES ('x', 1)",
        "CREATE TABLE crew(x INT)", "CREATE TABLE IF NOT EXISTS crew(x INT)", "CREATE OR REPLACE TABLE crew(x INT)", "SELECT * FROM crew", "UPDATE crew SET x = 1", "DELETE FROM crew", "BEGIN", "DROP TABLE crew", "SELECT * FROM crew", "DROP TABLE IF EXISTS crew", "DROP TABLE crew", "CREATE TABLE types(a INT)",
        oracle="SELECT CAST(s AS INTEGER) AS step, t AS tag, CAST(n AS BIGINT) AS n, e AS sqlstate FROM (VALUES (1, 'CREATE TABLE', NULL, NULL), (2, NULL, 2, NULL), (3, NULL, 2, NULL), (4, NULL, 4, NULL), (5, 'SET', NULL, NULL), (6, NULL, NULL, '42000'), (7, NULL, NULL, '42000'), (8, 'CREATE TABLE', NULL, NULL), (9, 'CREATE TABLE', NULL, NULL), (10, NULL, 0, NULL), (11, NULL, NULL, '42000'), (12, NULL, NULL, '42000'), (13, NULL, NULL, '42000'), (14, 'DROP TABLE', NULL, NULL), (15, NULL, NULL, '42000'), (16, 'DROP TABLE', NULL, NULL), (17, NULL, NULL, '42000'), (18, NULL, NULL, '42000')) v(s, t, n, e)"),
    "stmt_preloaded": Entry(_preloaded, "SELECT w AS what, TRUE AS holds FROM (VALUES ('registered'), ('listed'), ('counted'), ('system hidden'), ('table already exists: crew'), ('dropped'), ('system stays'), ('schemas')) v(w)"),
    "stmt_ctas": script(ORDERS, "CREATE TABLE halves AS SELECT o_orderkey, o_orderkey / 2 AS half, o_totalprice / 2 AS price FROM o", "SELECT * FROM halves", oracle="SELECT o_orderkey, o_orderkey // 2 AS half, o_totalprice / 2 AS price FROM orders"),
    "stmt_view": script(ORDERS, "CREATE VIEW halves AS SELECT o_orderkey, o_orderkey / 2 AS half FROM o ORDER BY NULLIF(o_orderstatus, 'F') DESC", "CREATE OR REPLACE VIEW quarters AS SELECT o_orderkey, half / 2 AS q FROM halves", "SELECT * FROM quarters", oracle="SELECT o_orderkey, o_orderkey // 4 AS q FROM orders"),
    **{f"stmt_external_{kind}": script(
        ORDERS, f"COPY (SELECT o_orderkey, o_totalprice, o_orderpriority FROM o) TO '<scratch>/{kind}' STORED AS {kind.upper()}",
        f"CREATE EXTERNAL TABLE back(o_orderkey BIGINT, o_totalprice DOUBLE, o_orderpriority TEXT) STORED AS {kind.upper()} LOCATION '<scratch>/{kind}'", "SELECT * FROM back",
        oracle="SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders") for kind in ("parquet", "csv", "json")},
    "stmt_copy_count": script(ORDERS, "COPY o TO '<scratch>/all' STORED AS PARQUET", oracle="SELECT COUNT(*) AS count FROM orders"),
    "stmt_show_tables": script("CREATE TABLE a1(x INT)", "CREATE TABLE a2(x INT)", "SELECT table_name AS name, table_type FROM information_schema.tables WHERE table_schema = 'public'", oracle="SELECT * FROM (VALUES ('a1', 'BASE TABLE'), ('a2', 'BASE TABLE')) t(name, table_type)"),
    "stmt_describe": script("CREATE TABLE a1(x INT, text TEXT, d DOUBLE PRECISION)", "DESCRIBE a1", oracle="SELECT col_name, data_type, CAST(NULL AS VARCHAR) AS comment FROM (VALUES ('x', 'int'), ('text', 'string'), ('d', 'double')) t(col_name, data_type)"),
    "stmt_explain": answers("EXPLAIN SELECT 1", "SHOW COLUMNS FROM system.types", "SHOW ALL WRONG", oracle="SELECT CAST(s AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS tag, CAST(n AS BIGINT) AS n, e AS sqlstate FROM (VALUES (1, 1, NULL), (2, 4, NULL), (3, NULL, '42000')) v(s, n, e)"),
    "info_schema_tables": script("CREATE TABLE info_rows(x INT)", "CREATE VIEW info_view AS SELECT x / 2 AS h FROM info_rows", "SELECT table_schema, table_name, table_type FROM information_schema.tables", oracle="SELECT * FROM (VALUES ('public', 'info_rows', 'BASE TABLE'), ('public', 'info_view', 'VIEW')) t(table_schema, table_name, table_type)"),
    "info_schema_columns": script("CREATE TABLE info_rows(x INT, y VARCHAR)", "SELECT t.table_name, c.column_name, c.ordinal_position / 2 AS half, c.data_type, 7 / 2 AS whole FROM information_schema.tables t JOIN information_schema.columns c ON t.table_name = c.table_name", oracle="SELECT * FROM (VALUES ('info_rows', 'x', CAST(0 AS BIGINT), 'int', CAST(3 AS BIGINT)), ('info_rows', 'y', 0, 'string', 3)) t(table_name, column_name, half, data_type, whole)"),
    "info_schema_schemata": sql("SELECT schema_name, 7 / 2 AS whole FROM information_schema.schemata WHERE information_schema.schemata.schema_name <> 'x'", "SELECT * FROM (VALUES ('public', CAST(3 AS BIGINT)), ('information_schema', 3)) t(schema_name, whole)"),
    "info_schema_others": sql("SELECT (SELECT COUNT(*) FROM information_schema.routines) > 100 AS routines, (SELECT COUNT(*) FROM information_schema.parameters) AS parameters, (SELECT value FROM information_schema.df_settings WHERE name = 'spark.sql.session.timeZone') AS zone, (SELECT COUNT(*) FROM information_schema.views) AS views", "SELECT TRUE AS routines, CAST(0 AS BIGINT) AS parameters, 'UTC' AS zone, CAST(0 AS BIGINT) AS views"),
    "render_text": Entry(_text, "SELECT CAST(a AS INTEGER) AS at, t AS text FROM (VALUES (0, '1'), (1, 't'), (2, '0.1'), (3, '100000000000000000000'), (4, NULL), (5, '2024-02-29'), (6, '{1,NULL,3}')) v(a, t)"),
    "render_json": Entry(_json, """SELECT '{"schema": [{"name": "name", "type": "Utf8"}, {"name": "age", "type": "Int32"}, {"name": "said", "type": "Utf8"}], "data": [{"name": "Ada", "age": 36, "said": 36}]}' AS json"""),
}
