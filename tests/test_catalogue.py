"""Every catalogue query against its SQL on DuckDB, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from brindle.queries import entries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ALL = entries()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for name in os.listdir(FOLDER):
        made.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return made


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)

    columns = sorted(df.columns)
    return sorted(tuple(one(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, con, name):
    got = ALL[name].run(spark, FOLDER).toPandas()
    if ALL[name].oracle is None:
        assert len(got)
        return
    want = con.sql(ALL[name].oracle).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_module_names_every_query(spark):
    import __spark_entry__ as e

    assert set(ALL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10
